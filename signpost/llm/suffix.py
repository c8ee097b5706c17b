"""Exact repeats of long passages: sampled blocks find where, whole windows tell what each is a repeat of."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost.llm.common import NO_ID, block_hashes, discard, earlier_alike, id_or_null, in_parts, map_arrow, sampled_blocks, text_keys, texts_with_spans, words_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORDS = 50
WINDOW = 16
GRAM = 3
# Windows that a task holds before it hands them on.
HELD_WINDOWS = 50_000


def first_places(suffixes: DataFrame) -> DataFrame:
    """Of suffixes that begin alike, the first by document and place; those of one text alone are left out."""
    where = F.struct("doc", "tag", "at")
    firsts = suffixes.where("earlier is null").groupBy("begins").agg(F.min(where).alias("of"), F.max(where).alias("last"))
    return firsts.where("of <> last").select("begins", "of")


def matches(suffixes: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(doc, tag, at, of_doc, of_tag, of_at)``: each suffix against one that begins alike.

    It is the last before it in its own text, and for a text's first one the first of all texts'.
    So a text that repeats itself matches at one distance, and adds nothing to what others meet.
    """
    own = suffixes.where("earlier is not null").select(
        "doc", "tag", "at", F.col("doc").alias("of_doc"), F.col("tag").alias("of_tag"), F.col("earlier").alias("of_at"))
    met = suffixes.where("earlier is null").join(firsts, "begins").where("not (doc = of.doc and tag = of.tag)")
    return own.unionByName(met.select(
        "doc", "tag", "at", F.col("of.doc").alias("of_doc"), F.col("of.tag").alias("of_tag"), F.col("of.at").alias("of_at")))


def _runs(suffixes: DataFrame, firsts: DataFrame, block: int) -> DataFrame:
    """``(doc, tag, low, high, of_doc, of_tag, of_low, of_high)``: suffixes in a row that repeat the same passage.

    See :func:`matches` for which is held against which. A run is as many suffixes of one text, no
    further apart than the block they share, that lie equally far from those they match.
    """
    met = matches(suffixes, firsts).withColumn("apart", F.col("at") - F.col("of_at")).drop("of_at").distinct()
    line = Window.partitionBy("doc", "tag", "of_doc", "of_tag", "apart").orderBy("at")
    begins = F.when(F.col("at") - F.lag("at").over(line) <= block, 0).otherwise(1)
    numbered = met.withColumn("begin", begins).withColumn("run", F.sum("begin").over(line))
    return numbered.groupBy("doc", "tag", "of_doc", "of_tag", "apart", "run").agg(F.min("at").alias("low"), F.max("at").alias("high")).select(
        "doc", "tag", "low", "high", "of_doc", "of_tag", (F.col("low") - F.col("apart")).alias("of_low"), (F.col("high") - F.col("apart")).alias("of_high"))


def _windows(docs: DataFrame, met: DataFrame, words: int, reach: int) -> DataFrame:
    """``(begins, doc, tag, at, earlier)``, as of ``sampled_blocks``: every window of ``words`` words that has a place of ``met``
    among its first ``reach`` words."""
    places = met.select("doc", "tag", "at").unionByName(met.select(
        F.col("of_doc").alias("doc"), F.col("of_tag").alias("tag"), F.col("of_at").alias("at")))
    lists = places.groupBy("doc", "tag").agg(F.collect_set(F.struct(F.col("at").alias("low"), F.col("at").alias("high"))).alias("spans"))
    texts = docs.select(*text_keys(), F.col("text").cast("string").alias("text"))
    rows = texts.join(lists, ["doc", "tag"]).select("doc", "tag", "text", "spans")

    def windows(batch: pa.RecordBatch):
        held, n = [], 0
        for doc, tag, data, at, _ in texts_with_spans(batch):
            hashes, _, _, _ = words_of(data, np.array([0, len(data)]))
            count = len(hashes) - words + 1
            if count < 1:
                continue
            steps = np.zeros(count + 1, np.int64)
            np.add.at(steps, np.clip(at - reach + 1, 0, count), 1)
            np.add.at(steps, np.clip(at + 1, 0, count), -1)
            place = np.flatnonzero(np.cumsum(steps[:count]) > 0)
            begins = block_hashes(hashes, place, place + words).view(np.int64)
            held.append((begins, np.full(len(place), doc), np.full(len(place), tag), place, earlier_alike(begins, np.zeros(len(place), np.int64), place)))
            n += len(place)
            if n >= HELD_WINDOWS:
                yield joined(held)
                held, n = [], 0
        if held:
            yield joined(held)

    def joined(held: list) -> list:
        *columns, earlier = zip(*held)
        return [*map(np.concatenate, columns), pa.concat_arrays(earlier)]

    return map_arrow(rows, lambda: windows, "begins long, doc long, tag long, at long, earlier long")


def _edges(docs: DataFrame, wanted: DataFrame, block: int, window: int) -> DataFrame:
    """For each ``(doc, tag, low, high)``: a hash of the passage, its place, and the words beside it (32 bits of their hashes),
    nearest first."""
    lists = wanted.groupBy("doc", "tag").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    texts = docs.select(*text_keys(), F.col("text").cast("string").alias("text"))
    rows = texts.join(lists, ["doc", "tag"]).select("doc", "tag", "text", "spans")

    def edges(batch: pa.RecordBatch):
        for doc, tag, data, lows, highs in texts_with_spans(batch):
            hashes, starts, ends, _ = words_of(data, np.array([0, len(data)]))
            short = hashes.view(np.int32)[::2]
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
            for low, last in zip(lows.tolist(), highs.tolist()):
                high = last + block
                if high > len(starts):  # a span of another text of this id and tag
                    continue
                before = slice(max(0, low - window), low)
                yield (doc, tag, low, last, xxhash.xxh3_64_intdigest(hashes[low:high].tobytes()) >> 1,
                       int(chars[starts[low]]), int(chars[ends[high - 1]]), short[before][::-1], short[high:high + window],
                       chars[starts[before]][::-1], chars[ends[high:high + window]])

    def make():
        return lambda batch: in_parts(edges(batch))

    return map_arrow(rows, make, "doc long, tag long, low long, high long, passage long, start int, end int, "
                                 "before array<int>, after array<int>, starts array<int>, ends array<int>")


def _alike(a: str, b: str) -> Column:
    """How many leading items two arrays share."""
    unlike = F.expr(f"array_position(transform(sequence(1, greatest(1, least(size({a}), size({b})))), i -> {a}[i - 1] <=> {b}[i - 1]), false)")
    shorter = F.least(F.size(a), F.size(b))
    return F.when(shorter == 0, 0).when(unlike == 0, shorter).otherwise(unlike - 1).cast("int")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """Every later occurrence of a passage of ``min_words`` words or more, and where it occurred first.

    Returns ``doc_id, first_word, words, start, end, of_doc_id, of_first_word``, one row for each
    maximal stretch that a text shares with an earlier one (of smaller ``doc_id``) or with an
    earlier place of itself; ``start`` and ``end`` count characters. Words are compared exactly,
    white space between them is not.

    Suffixes are retained where a word begins the least 3-gram of ``window`` neighbouring ones:
    every passage of ``min_words`` words has one among its first ``window`` words, in all its
    copies alike. Suffixes that share their first ``min_words - window + 1`` words tell where
    repeats can be. There every window of ``min_words`` words is held against its first
    occurrence (or the last before it in its own text), so each word of a repeat that long is in a
    row, whoever holds parts of it. Windows in a row that lie equally far from those they match
    are joined, verified by a second hash and extended word by word to both sides. Nothing is
    capped: a passage that many texts hold gives a row for each, all against the first. Where an
    earlier text holds only a part of at least ``min_words`` words, the passage is reported in
    such parts; shorter ones are not reported.

    A null or short text gives no rows. Rows without a ``doc_id`` rank last and report null. Rows
    that repeat both ``doc_id`` and text are one text and are each reported. Other columns are
    ignored.
    """
    if min_words < window + GRAM:
        raise ValueError("the window must be shorter than the passages by at least a 3-gram")
    suffixes = written(sampled_blocks(docs, GRAM, min_words - window + 1, window), "suffixes")
    firsts = written(first_places(suffixes), "firsts")
    windows = written(_windows(docs, matches(suffixes, firsts), min_words, window), "windows")
    discard(suffixes, firsts)
    firsts = written(first_places(windows), "firsts")
    block = min_words
    runs = written(_runs(windows, firsts, block), "runs")
    discard(windows, firsts)
    wanted = runs.select("doc", "tag", "low", "high").unionByName(
        runs.select(F.col("of_doc").alias("doc"), F.col("of_tag").alias("tag"), F.col("of_low").alias("low"), F.col("of_high").alias("high"))).distinct()
    edges = written(_edges(docs, wanted, block, window), "edges")
    there = edges.dropDuplicates(["doc", "tag", "low", "high"]).select(
        F.col("doc").alias("of_doc"), F.col("tag").alias("of_tag"), F.col("low").alias("of_low"), F.col("high").alias("of_high"),
        F.col("passage").alias("of_passage"), F.col("before").alias("of_before"), F.col("after").alias("of_after"))
    met = runs.join(edges, ["doc", "tag", "low", "high"]).join(written(there, "places"), ["of_doc", "of_tag", "of_low", "of_high"])
    met = met.where("passage = of_passage").select(
        "*", _alike("before", "of_before").alias("left"), _alike("after", "of_after").alias("right"))
    return met.select(
        id_or_null("doc").alias("doc_id"), (F.col("low") - F.col("left")).alias("first_word"),
        (F.col("high") - F.col("low") + block + F.col("left") + F.col("right")).alias("words"),
        F.expr("if(left > 0, starts[left - 1], start)").alias("start"), F.expr("if(right > 0, ends[right - 1], end)").alias("end"),
        id_or_null("of_doc").alias("of_doc_id"), (F.col("of_low") - F.col("left")).alias("of_first_word"), "tag")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """``documents`` with only the first occurrence of each passage of ``min_words`` or more left in their texts.

    Shorter repeats stay. Rows whose text holds nothing else are dropped; all others keep all their columns.
    """
    doc, tag = text_keys()
    found = repeated_passages(docs, min_words, window).groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), F.col("tag").alias("_tag")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    rows = docs.select(F.struct("*").alias("row"), doc, tag).join(
        written(found, "spans"), (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left")
    # Spans in order; what lies between the furthest end so far and the next start stays.
    left = F.expr(
        "aggregate(_spans, named_struct('at', 0, 'text', ''), (s, x) -> named_struct('at', greatest(s.at, x.end), "
        "'text', concat(s.text, substring(row.text, s.at + 1, greatest(0, x.start - s.at)))), "
        "s -> concat(s.text, substring(row.text, s.at + 1)))")
    fields = [F.when(F.col("_spans").isNull(), F.col("row.text")).otherwise(left).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    kept = rows.select("_spans", *[f.alias(f"c{i}") for i, f in enumerate(fields)])
    text = f"c{docs.columns.index('text')}"
    kept = kept.where(F.col("_spans").isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
