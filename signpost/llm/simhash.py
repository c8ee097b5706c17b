"""SimHash near-duplicates through multi-index hashing."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.llm.common import NO_ID, components, map_arrow, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
HALF = 32


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text: each bit as in most of its shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return hash64(b" ".join(words), SEED)
    parts = zip(*(words[i:] for i in range(shingle)))
    hashes = np.fromiter((hash64(s, SEED) for s in map(b" ".join, parts)), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row: the SimHash of its whole text as a signed long.

    ASCII letters are lower-cased, words are cut at ASCII white space and shingles are
    space-joined; a text of fewer words is one shingle, and a null text or one without words has
    the fingerprint 0.
    """
    return _printed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id long", shingle)


def _printed(rows: DataFrame, keys: str, shingle: int) -> DataFrame:
    """``rows`` with ``fp`` in the place of their last column, the text; ``keys`` are the others' types."""
    def make():
        def run(batch: pa.RecordBatch):
            *others, text = batch.columns
            prints = np.array([fingerprint(t, shingle) if t else 0 for t in text.cast(pa.binary()).to_pylist()], np.uint64)
            yield [*others, pa.array(prints.view(np.int64))]
        return run

    return map_arrow(rows, make, f"{keys}, fp long")


def linked(prints: DataFrame, bits: int = 3) -> DataFrame:
    """``(a, b)`` with a < b: distinct fingerprints that differ in at most ``bits`` (3) places.

    Of two such fingerprints, the high or the low half differs in at most one place. Every half
    is looked up in the table of all halves: as it is, and with each of its zeros set in turn (of
    two halves one bit apart, one has a zero there). Matches are verified over all 64 bits.
    """
    if bits > 3:
        raise ValueError("halves one bit apart cover at most 3 differing bits")
    segments = F.array(*(F.struct(F.lit(s).alias("segment"), value.alias("value")) for s, value in enumerate((
        F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))))))
    table = prints.select("fp", F.inline(segments))
    ball = F.expr(
        f"concat(array(value), transform(filter(sequence(0, {HALF - 1}), i -> (shiftright(value, i) & 1) = 0), "
        "i -> value | shiftleft(1L, i)))")
    probes = table.select(F.col("fp").alias("probe"), "segment", "value", F.explode(ball).alias("near"))
    met = probes.join(table.select("fp", "segment", F.col("value").alias("near")), ["segment", "near"])
    # Of two fingerprints with one half in common, either finds the other; one of them is enough.
    met = met.where("(near <> value or probe < fp) and probe <> fp")
    met = met.where(F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= bits)
    return met.select(F.least("probe", "fp").alias("a"), F.greatest("probe", "fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, bits: int = 3, shingle: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``documents``.

    Equal fingerprints are one class (their count is summed before any shuffle), classes are
    linked by :func:`linked`, and ``component_id`` is the smallest ``doc_id`` reachable by links.
    Rows whose ``doc_id`` is null count in links but name no component; a component of nothing
    else is null. Repeated rows each keep their row, other columns are ignored, an empty table
    gives an empty result.
    """
    rows = written(with_fingerprints(docs, shingle), "fingerprints")
    return _labelled(rows, bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(rows: DataFrame, bits: int) -> DataFrame:
    """Rows with ``fp`` and the smallest ``doc_id`` (any value that has an order) of their component."""
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    member = components(linked(classes.select("fp"), bits))
    roots = classes.join(member, classes.fp == member.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    least = written(roots.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    labels = written(roots.join(least, "root").select("fp", "component_id"), "labels")
    return rows.join(labels, "fp")


def row_keys() -> tuple[Column, Column]:
    """What tells rows apart: ``doc_id`` (rows without one come last) and 64 bits of the text's hash."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("tag")


def rows_of(docs: DataFrame, staying: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose keys are in ``staying`` (``doc, tag, n``), one for each key that ``n`` rows repeat.

    All columns are returned, under whatever names they have. The text moves once.
    """
    packed = docs.select(F.struct("*").alias("row"), *row_keys())
    once = packed.join(staying.where("n = 1"), ["doc", "tag"], "left_semi").select("row.*")
    again = packed.join(staying.where("n > 1"), ["doc", "tag"]).groupBy("doc", "tag").agg(
        F.min_by("row", F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("row"))
    return once.unionByName(again.select("row.*"))


def keep_one_of_each(docs: DataFrame, bits: int = 3, shingle: int = 3) -> DataFrame:
    """The rows of ``documents`` but near copies: of each component the smallest ``doc_id`` stays.

    Rows that share a ``doc_id`` but not their text are rows of their own: of each component the
    row of the least ``doc_id`` and text hash stays. A row without a ``doc_id`` is ranked behind
    those with one. Of rows that repeat both, one stays. All columns are returned.
    """
    rows = _printed(docs.select(*row_keys(), F.col("text").cast("string").alias("text")), "doc long, tag long", shingle)
    rows = written(rows.select(F.struct("doc", "tag").alias("doc_id"), "fp"), "fingerprints")
    staying = _labelled(rows, bits).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    return rows_of(docs, written(staying.select("doc_id.doc", "doc_id.tag", "n"), "staying"))
