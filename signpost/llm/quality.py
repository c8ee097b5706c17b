"""Text quality by a sparse ensemble of rules, compiled into Spark columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.llm.common import held_out, written

TRAINING_ROWS = 20_000
TREES = 24
DEPTH = 3
PENALTY = 0.002

Condition = tuple[int, float, float]


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns and ``counted``, statistics of the whole ``text``, 0 where there is nothing to count.

    The text is split once: a later step reads the words and lines that an earlier one made.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(*keep, text.alias("_text")).select(
        *keep, "_text", F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"), F.split("_text", "\n").alias("_lines"))
    kinds = split.select(
        *keep, "_text", "_words", "_lines", F.regexp_replace("_text", r"[^\p{L}]+", "").alias("_letters"))
    left = lambda column, pattern: F.length(F.regexp_replace(column, pattern, ""))
    return kinds.select(*keep, F.struct(
        F.length("_text").alias("characters"), F.size("_words").alias("words"), F.size(F.array_distinct("_words")).alias("distinct_words"),
        F.coalesce(F.array_max(F.transform("_words", F.length)), F.lit(0)).alias("longest_word"),
        F.size("_lines").alias("lines"), F.size(F.array_distinct("_lines")).alias("distinct_lines"),
        left("_text", r"[\p{L}\p{N}\x20\x09-\x0D]+").alias("marks"), F.length("_letters").alias("letters"),
        left("_letters", r"[^\p{Lu}]+").alias("capitals"), left("_text", r"[^\p{N}]+").alias("digits"),
    ).alias("counted"))


FEATURES = ("log_words", "letter_share", "capital_share", "digit_share", "mark_share", "word_length",
            "longest_word", "distinct_word_share", "distinct_line_share", "words_a_line", "word_repeats")


def features(counted: str) -> list[Column]:
    """The features of :data:`FEATURES`, doubles, from a struct of :func:`statistics`."""
    c = lambda name: F.col(f"{counted}.{name}").cast("double")
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1.0))
    return [F.log1p(c("words")), share("letters", "characters"), share("capitals", "letters"), share("digits", "characters"),
            share("marks", "characters"), share("characters", "words"), c("longest_word"), share("distinct_words", "words"),
            share("distinct_lines", "lines"), share("words", "lines"), share("words", "distinct_words")]


def paths(tree: str) -> list[tuple[Condition, ...]]:
    """The conjunctions that lead to each node of a tree, as bounds ``(feature, above, up to)``, from its printed form."""
    out, held = [], []
    for line in tree.splitlines():
        found = re.search(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEeInfity]+)\)", line)
        if not found:
            continue
        level, feature, value = len(found[1]), int(found[2]), float(found[4])
        held = [h for h in held if h[0] < level] + [(level, feature, found[3], value)]
        bounds: dict[int, list[float]] = {}
        for _, f, side, v in held:
            low_high = bounds.setdefault(f, [float("-inf"), float("inf")])
            low_high[0] = max(low_high[0], v) if side == ">" else low_high[0]
            low_high[1] = min(low_high[1], v) if side == "<=" else low_high[1]
        out.append(tuple((f, low, high) for f, (low, high) in sorted(bounds.items())))
    return out


def rule(conditions: Sequence[Condition], values: str) -> Column:
    """A conjunction as a condition on an array column of feature values."""
    parts = []
    for feature, low, high in conditions:
        value = F.element_at(F.col(values), feature + 1)
        parts += [value > low] * (low > float("-inf")) + [value <= high] * (high < float("inf"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole & part
    return whole


class Rules:
    """Weighted rules: the score is the logistic function of the sum of the weights of those that hold."""

    def __init__(self, intercept: float, weighted: list[tuple[tuple[Condition, ...], float]]):
        self.intercept, self.weighted = intercept, weighted

    def score(self, values: str) -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.weighted:
            total = total + F.when(rule(conditions, values), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def __str__(self) -> str:
        name = lambda c: " and ".join(f"{low:g} < {FEATURES[f]} <= {high:g}" for f, low, high in c)
        return "\n".join(f"{weight:+.3f} {name(c)}" for c, weight in sorted(self.weighted, key=lambda w: -abs(w[1])))


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 3) -> Rules:
    """Rules from rows with ``values`` (array of features) and ``label`` (0 or 1).

    A forest of shallow trees gives the rules: every path from a root is a conjunction of bounds.
    Logistic regression with an absolute-value penalty weighs them, and those of no weight go.
    Without rows of both labels there are no rules, and the score is the share of label 1 (a half
    without any rows).
    """
    rows = labelled.select(array_to_vector("values").alias("features"), F.col("label").cast("double").alias("label"), "values")
    counts = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Rules(50.0 if 1 in counts else -50.0 if counts else 0.0, [])
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.8, featureSubsetStrategy="onethird", seed=seed).fit(rows)
    found = sorted({path for tree in forest.trees for path in paths(tree.toDebugString)})
    if not found:
        share = F.log(F.lit(counts[1] / counts[0]))
        return Rules(float(rows.sparkSession.range(1).select(share).first()[0]), [])
    held = F.array(*(F.when(rule(path, "values"), 1.0).otherwise(0.0) for path in found))
    table = written(rows.select("label", held.alias("held")), "rules").select("label", array_to_vector("held").alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(table)
    weights = model.coefficients.toArray()
    return Rules(float(model.intercept), [(path, float(w)) for path, w in zip(found, weights) if w])


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    return statistics(docs, *keep).select(*keep, F.array(*features("counted")).alias("values"))


def learn(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, **how) -> Rules:
    """Rules for the quality that ``labels`` marks, from about ``training_rows`` labelled rows that are not held out.

    They are those whose ``doc_id`` hashes lowest. Of a document with several labels the least
    counts; labels that are null or name no document are ignored.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("label"))
    marks = marks.where(~held_out(F.col("id")))
    total = marks.count()
    share = F.shiftrightunsigned(F.xxhash64("id", F.lit(1)), 11) / float(1 << 53)
    chosen = written(marks.where(share < training_rows / max(1, total)), "labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("id")).select("text", "label")
    return fit(written(_measured(rows, "label"), "measured"), **how)


def scored(docs: DataFrame, rules: Rules, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``documents``.

    ``score``, from 0 to 1, is higher where quality 1 is likelier, and ``predicted`` is 1 from
    ``threshold`` on. Only the text is looked at, all of it, in column expressions; a null text
    is scored as an empty one. Rows may repeat or lack a ``doc_id`` (they are then not held out).
    """
    values = _measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    rows = values.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), rules.score("values").alias("score"))
    return rows.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_of(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """:func:`scored` by what :func:`learn` finds in the rows that are not held out."""
    return scored(docs, learn(docs, labels, **how))
