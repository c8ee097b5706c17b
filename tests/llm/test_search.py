"""Ranked search against scoring every document, over one block and over many."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from signpost.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, n long, terms string, term string, score string, rank int, item int"
ITEMS = "item_id long, text string, terms string, doc_id long, term int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def documents(spark, rows):
    return spark.createDataFrame([(*r, "en", 1, "t", "u", "s", 2, 3) for r in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2) for r in rows], ITEMS)


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = Counter()
    for item, own in wanted.items():
        scored = []
        for doc, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc, score))
        for rank, (_, _, doc, score) in enumerate(sorted(scored, key=lambda s: s[:2] + (s[2] or 0,))[:k], 1):
            out[item, rank, doc, score] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Été", "ñandú", "ÀB", "x9"]
    text = lambda n: "".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))])[0] + rng.choice([" ", "-", "\x1c", "_", ". "]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(400)]
    docs += [(500 + i, docs[3][1]) for i in range(40)]  # ties
    docs += [(600, None), (601, ""), (602, " .,;"), (603, "w1 " * 30_000), (604, docs[9][1].upper()), (7, docs[7][1]), (7, "w2 w3"),
             (None, docs[11][1]), (None, None), (605, "w5" * 3_000), (606, "Ⅷ é  w1")]
    items = [(i, text(rng.randint(2, 25))) for i in range(20)] + [
        (30, None), (31, ""), (32, "nowhere to be found"), (33, docs[3][1]), (33, "w5 Ⅷ"), (None, "w1 w250 w260"), (34, "W1 w1  W1")]
    return docs, items


@pytest.mark.parametrize("k, terms_each, postings", [(10, 100_000, 1_000_000), (50, 60, 400), (3, 100_000, 50)])
def test_ranks_equal_scoring_everything(spark, rows, k, terms_each, postings, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(ranking, "BATCH_DOCS", 16)
    docs, items = rows
    got = ranking.ranked_documents(documents(spark, docs), items_of(spark, items), k, terms_each)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute(docs, items, k)


def test_reading_stops_before_the_lists_end():
    """Few documents hold all of an item's terms: they are found at the heads, and the rest of the lists is not read."""
    rng = np.random.default_rng(3)
    n = 20_000
    of = np.concatenate([np.arange(n), np.arange(n)])
    term = np.repeat([0, 1], n)
    impact = rng.integers(1, 1_000, 2 * n)
    impact[:5], impact[n:n + 5] = 5_000, 5_000
    block = ranking._Block(np.arange(n), of, term, impact, 2)
    looked = []
    greatest = ranking._greatest
    try:
        ranking._greatest = lambda s, d, k: looked.append(len(s)) or greatest(s, d, k)
        scores, docs = block.best(np.array([0, 1]), (np.empty(0, np.int64), np.empty(0, np.int64)), 5)
    finally:
        ranking._greatest = greatest
    assert docs.tolist() == [0, 1, 2, 3, 4] and set(scores.tolist()) == {10_000} and sum(looked) < 100


def test_empty_tables(spark):
    some = [(1, "a b")]
    for docs, items in (([], some), (some, []), ([], []), ([(1, None)], some)):
        assert ranking.ranked_documents(documents(spark, docs), items_of(spark, items)).collect() == []
