"""Ranked lexical search: impact lists read by the Best Position Algorithm."""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from signpost.llm.common import NO_ID, discard, id_or_null, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 50
# Distinct terms of the items that one pass over the documents looks for, about.
TERMS_EACH = 100_000
# Postings whose impact lists a task holds at once, about; they belong to less than 65 536 documents.
BLOCK_POSTINGS = 1_000_000
BATCH_DOCS = 4_096
# Sorted accesses to each list in the first round; every round reads twice as many.
FIRST_DEPTH = 16

# A-Z lower-cased, other bytes of ASCII but digits and letters to spaces; all others stay.
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_SEGMENT = 1 << 20


def counted(text: bytes, wanted: dict[bytes, int] | None = None) -> tuple[int, Counter]:
    """The number of a text's terms, and how often each term (each wanted one) occurs. Long texts are split in parts."""
    plain, at, n, held = text.translate(_PLAIN), 0, 0, Counter()
    while at < len(plain):
        to = plain.find(b" ", at + _SEGMENT)
        to = len(plain) if to < 0 else to
        words = plain[at:to].split()
        n += len(words)
        held.update(words if wanted is None else filter(wanted.__contains__, words))
        at = to
    return n, held


def _arrow(df: DataFrame, run, schema: str) -> DataFrame:
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(source):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(batches, kind)


def _terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``: the distinct terms of every item, those of rows that share an ``item_id`` together."""
    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                terms = [t.decode() for t in counted(text or b"")[1]]
                yield [[item] * len(terms), terms]

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return _arrow(rows, run, "item_id long, term string").distinct()


def _postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``(doc, n, terms, tfs)`` of every document with a term: its length, and the wanted terms it holds with their counts."""
    def run(batches):
        wanted = {t.encode(): i for i, t in enumerate(vocabulary)}
        for batch in batches:
            out = ([], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                n, held = counted(text, wanted) if text else (0, {})
                if n:
                    for column, value in zip(out, (doc, n, [wanted[t] for t in held], list(held.values()))):
                        column.append(value)
            yield out

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    return _arrow(rows, run, "doc long, n long, terms array<int>, tfs array<long>")


class _Block:
    """The impact lists of some documents: a list for each term, by falling impact."""

    def __init__(self, docs: np.ndarray, of: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        order = np.lexsort((of, -impact, term))
        self.docs, self.of, self.impact = docs, of[order].astype(np.uint16), impact[order]
        self.first = np.searchsorted(term[order], np.arange(terms + 1))

    def best(self, terms: np.ndarray, top: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``top`` (scores, docs), the best of an item so far, with the documents of this block.

        Lists are read from their heads, each document found is looked up in all lists of the item, and
        its places there are seen. A document not yet found lies behind the first unseen place of
        every list, so its score is at most the sum of the impacts there; once that is below the
        k-th best, the block can add no more.
        """
        begin, end = self.first[terms], self.first[terms + 1]
        places = _ranges(begin, end)
        of, impact = self.of[places], self.impact[places]
        end = np.cumsum(end - begin)
        begin = np.concatenate([[0], end[:-1]])
        # For direct access: the places of each document.
        by_doc = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=len(self.docs))
        last = np.cumsum(counts)
        seen, met = np.zeros(len(of), bool), np.zeros(len(self.docs), bool)
        reach, place, depth = begin, begin.copy(), FIRST_DEPTH
        while len(of):
            to = np.minimum(reach + depth, end)
            new = np.zeros(len(self.docs), bool)
            new[of[_ranges(reach, to)]] = True
            new = np.flatnonzero(new & ~met)
            reach = to
            if len(new):
                met[new] = True
                held = by_doc[_ranges(last[new] - counts[new], last[new])]
                seen[held] = True
                scores = np.add.reduceat(impact[held], np.cumsum(counts[new]) - counts[new])
                top = _greatest(np.concatenate([top[0], scores]), np.concatenate([top[1], self.docs[new]]), k)
            for i, (at, stop) in enumerate(zip(place.tolist(), end.tolist())):
                while at < stop:
                    part = seen[at:min(at + depth, stop)]
                    gap = int(part.argmin())
                    if not part[gap]:
                        at += gap
                        break
                    at += len(part)
                place[i] = at
            bound = int(impact[place[place < end]].sum())
            if not bound or len(top[0]) == k and bound < top[0][-1]:
                break
            depth *= 2
        return top


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All of ``low[i] ... high[i] - 1``, one after another."""
    counts = high - low
    return np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def _greatest(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k:
        near = scores >= np.partition(scores, -k)[-k]
        scores, docs = scores[near], docs[near]
    order = np.lexsort((docs, -scores))[:k]
    return scores[order], docs[order]


def _ranked(postings: DataFrame, items: list[tuple[int | None, list[int]]], weights: np.ndarray, k: int) -> DataFrame:
    """``(item, doc, score)``: of every task's documents the ``k`` best for each item (its number in ``items``)."""
    def run(batches):
        terms = [np.array(t, np.int64) for _, t in items]
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        top = [none] * len(items)

        def read(rows):
            doc, m, term, tf, counts = (np.concatenate(x) for x in zip(*rows))
            of = np.repeat(np.arange(len(doc)), counts)
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[of]))
            some = impact > 0
            block = _Block(doc, of[some], term[some], impact[some], len(weights))
            for i, own in enumerate(terms):
                top[i] = block.best(own, top[i], k)

        held, docs, size = [], 0, 0
        for batch in (b.slice(at, BATCH_DOCS) for b in batches for at in range(0, b.num_rows, BATCH_DOCS)):
            lists = batch.column(2)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), lists.flatten().to_numpy(),
                         batch.column(3).flatten().to_numpy(), lists.value_lengths().to_numpy()))
            docs, size = docs + batch.num_rows, size + len(held[-1][2])
            if size >= BLOCK_POSTINGS or docs + BATCH_DOCS > 1 << 16:
                read(held)
                held, docs, size = [], 0, 0
        if held:
            read(held)
        for i, (scores, docs) in enumerate(top):
            if len(scores):
                yield [[i] * len(scores), docs, scores]

    return _arrow(postings, run, "item int, doc long, score long")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = K, terms_each: int = TERMS_EACH) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of the highest score above 0 for every item, ties by ``doc_id``.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, in whole
    texts; only A-Z are lower-cased. With N documents of at least one term, L terms in all, n in one
    document, df documents of a term and tf of it in one document: a term weighs
    w = floor(1000 ln((2N+2)/(2df+1))), m = 50 + (50 n N) div L, and a document scores the sum over
    the item's distinct terms of w ((10^9 tf) div (1000 tf + 20 m)).

    One pass over the documents counts the items' terms in them; the counts give the statistics and,
    in each task, the lists of the postings by falling impact, which :meth:`_Block.best` reads with the
    k-th score of the task's earlier documents in hand. Every task returns its ``k`` best of each item,
    so what is shuffled follows tasks and items. Items are taken in groups of about ``terms_each``
    distinct terms, with a pass for each; what a pass sends to the tasks is so bounded (but for one
    item of more terms than that).

    Null and empty texts hold no term. Rows that share an ``item_id`` (null too) are one item. Rows of
    documents are documents of their own, repeated ones too; those without a ``doc_id`` come last among
    equal scores. Items without terms or documents have no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    terms = written(_terms(items), "terms")
    groups = max(1, math.ceil(terms.count() / terms_each))
    group = F.pmod(F.xxhash64("item_id"), F.lit(groups))
    found = None
    for g in range(groups):
        own = terms.where(group == g).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        vocabulary = sorted({t for row in own for t in row.terms})
        if not vocabulary:
            continue
        number = {t: i for i, t in enumerate(vocabulary)}
        wanted = [(row.item_id, [number[t] for t in row.terms]) for row in own]
        postings = written(_postings(docs, vocabulary), "postings")
        n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        for row in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
            weights[row.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row.df + 1)))
        length = F.expr(f"50 + cast((cast(n as decimal(20, 0)) * {50 * n_docs}BD) div {n_terms}BD as long)")
        best = _ranked(postings.where("size(terms) > 0").select("doc", length.alias("m"), "terms", "tfs"), wanted, weights, k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(wanted)], "item int, item_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(names, "item")
        best = written(best.select("item_id", "rank", id_or_null("doc").alias("doc_id"), "score"), "ranked")
        discard(postings)
        found = best if found is None else found.unionByName(best)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found
