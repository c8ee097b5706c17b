"""The rule ensemble: held-out accuracy, rules as written, and odd rows."""

import random
import zlib

from signpost.llm import quality


def labelled(spark, n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('nrst')}" * rng.randint(1, 3) for _ in range(rng.randint(20, 120))]
        kind = rng.randrange(3)
        if bad:
            words = [w.upper() for w in words] if kind == 0 else [words[0]] * len(words) if kind == 1 else [w + "%%#" for w in words]
        docs.append((i, " ".join(words), 1, 2.0))
        labels.append((i, int(not bad), 0, "x"))
    docs += [(n, None, 1, 2.0), (n + 1, "", 1, 2.0), (None, "some text", 1, 2.0), (3, docs[3][1], 1, 2.0), (n + 2, "word " * 50_000, 1, 2.0)]
    labels += [(None, 1, 0, "x"), (n, None, 0, "x"), (999_999, 0, 0, "x"), (3, labels[3][1], 0, "x")]
    return (spark.createDataFrame(docs, "doc_id long, text string, label int, score double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))


def test_held_out_documents_are_told_apart(spark):
    docs, labels = labelled(spark)
    got = quality.quality_of(docs, labels).collect()
    assert len(got) == docs.count() and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.doc_id < 400}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(unseen) > 40 and sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.95 * len(unseen)


def test_no_labels_or_rows(spark):
    docs, labels = labelled(spark, 10)
    none = quality.quality_of(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_of(docs.where("false"), labels).collect() == []
    ones = quality.quality_of(docs, labels.where("quality = 1")).collect()
    assert all(r.predicted == 1 for r in ones)


def test_paths_are_bounds_of_each_node():
    tree = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5
  If (feature 3 <= 0.25)
   If (feature 1 <= 2.0E-4)
    Predict: 0.0
   Else (feature 1 > 2.0E-4)
    Predict: 1.0
  Else (feature 3 > 0.25)
   Predict: 0.0
"""
    inf = float("inf")
    assert quality.paths(tree) == [((3, -inf, 0.25),), ((1, -inf, 2e-4), (3, -inf, 0.25)), ((1, 2e-4, inf), (3, -inf, 0.25)), ((3, 0.25, inf),)]


def test_statistics_cover_whole_texts(spark):
    text = "One TWO two\n\nÉé 12!? two\tOne"
    row = quality.statistics(spark.createDataFrame([(text,)], "text string")).first().counted
    assert row.asDict() == {"characters": len(text), "words": 7, "distinct_words": 5, "longest_word": 4, "lines": 3, "distinct_lines": 3,
                            "marks": 2, "letters": 17, "capitals": 6, "digits": 2}
