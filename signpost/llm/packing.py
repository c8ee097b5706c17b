"""Packing tokenised documents into fixed-length sequences by exact complements, then best fit."""

from __future__ import annotations

import base64
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signpost.llm.common import map_arrow, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"

# In these characters every library agrees on what a letter, a digit and a space is.
_PLAIN = re.compile(r"[\t\n\r -~¡-©«-±´¶-¸»¿-ſ‐-‧€]*")


def encoder(vocabulary: str = VOCABULARY):
    """A function from a text to its ids, equal to those of ``tokenizers`` for the JSON file.

    Plain Latin text goes through the same vocabulary as byte ranks, some four times as fast;
    text with any other character, or with the name of the special token, goes through the JSON
    file itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    special = re.compile("|".join(re.escape(t.content) for t in full.get_added_tokens_decoder().values()) or r"(?!)")
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and not special.search(text):
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(full.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every row of ``documents``.

    A row's tokens are its text's ids and a final 0; a null or empty text is that 0 alone. Only
    rows of more than ``capacity`` tokens are cut: the first piece takes what is over, the others
    are full.
    """
    def make():
        encode = encoder(vocabulary)

        def run(batch: pa.RecordBatch):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text) if text else np.empty(0, "<u4"), np.array([0], "<u4"))
                start, end = 0, (len(ids) - 1) % capacity + 1
                piece = 0
                while start < len(ids):
                    part = ids[start:end]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())) + ((part.tolist(),) if with_ids else ()))
                    start, end, piece = end, end + capacity, piece + 1
            if rows:
                yield list(zip(*rows))
        return run

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                     make, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, number)`` of the sequences to make from so many pieces of each length.

    From the longest length down, the gap beside a piece is filled exactly where one, two or three
    available lengths sum to it, as often as the rarest of them allows; the sums of pairs are
    looked up by complement. What has no exact filling goes, longest first, to the fullest open
    sequence that takes it. Work depends on the number of lengths, not of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    plan: dict[tuple[int, ...], int] = defaultdict(int)
    if left[capacity]:
        plan[(capacity,)] += int(left[capacity])
        left[capacity] = 0

    def taken(lengths: tuple[int, ...]) -> int:
        """How often these lengths can be had together."""
        return min(int(left[x]) // lengths.count(x) for x in set(lengths))

    def filling(length: int) -> tuple[int, ...] | None:
        gap = capacity - length
        if left[gap] > (gap == length):
            return (gap,)
        have = left[:gap + 1] > 0
        low = np.arange(1, gap // 2 + 1)
        pairs = low[have[low] & have[gap - low]]
        for a in pairs[::-1]:
            if taken((length, int(a), gap - int(a))):
                return (gap - int(a), int(a))
        # The longest third piece first; the two others are again a pair of complements.
        for c in np.flatnonzero(have)[::-1]:
            rest = gap - int(c)
            low = np.arange(1, rest // 2 + 1)
            for a in low[have[low] & have[rest - low]][::-1]:
                if taken((length, int(c), int(a), rest - int(a))):
                    return (int(c), rest - int(a), int(a))
        return None

    for length in range(capacity - 1, 0, -1):
        while left[length]:
            found = filling(length)
            if found is None:
                break
            whole = (length, *found)
            n = taken(whole)
            plan[whole] += n
            for x in whole:
                left[x] -= n

    open_by_gap: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    gaps = np.zeros(capacity + 1, bool)
    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                held, there = open_by_gap[gap].popitem()
            else:
                gap, held, there = capacity, (), -(-n // (capacity // length))
            put = min(n, there)
            if put < there and held:
                open_by_gap[gap][held] += there - put
            n -= put
            open_by_gap[gap - length][(*held, length)] += put
            gaps[[gap, gap - length]] = bool(open_by_gap[gap]), True
            gaps[0] = False
    for held in open_by_gap.values():
        for lengths, n in held.items():
            plan[lengths] += n
    return list(plan.items())


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank, first sequence and offset of every run of pieces that a plan places."""
    rows, used, sequence = defaultdict(list), defaultdict(int), 0
    for lengths, n in plan:
        offset = 0
        for length in lengths:
            rows[length].append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return {length: tuple(np.array(x, np.int64) for x in zip(*runs)) for length, runs in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``length`` from 1 to ``capacity``, and the ``sequence_id`` and ``offset`` of each.

    The plan is made on the driver from the count of each length, ``capacity`` numbers whatever
    the input; it places runs of the pieces of a length. A piece finds its run by its rank among
    the pieces of its length: the count of that length in earlier partitions of a written table,
    and its rank within its own, so that a length of very many pieces is ranked in many tasks.
    """
    rows = written(pieces.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "pieces")
    counts = written(rows.groupBy("_part", "length").agg(F.count("*").alias("n")), "lengths")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = rows.sparkSession.sparkContext.broadcast(_places(plan_packing(total, capacity)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_part", F.col("length").alias("_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part", "length").orderBy("_row")
    ranked = rows.withColumn("_nth", F.row_number().over(within)).join(
        base.withColumnRenamed("_part", "_of"), (F.col("_part") == F.col("_of")) & (F.col("length") == F.col("_length")))
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_nth") - 1).alias("_rank"))
    at, kind = ranked.columns.index("length"), ranked.drop("_rank").schema

    def make():
        runs = places.value

        def run(batch: pa.RecordBatch):
            if not batch.num_rows:
                return
            lengths, ranks = batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                first, begin, place = runs[int(length)]
                which = np.searchsorted(first, ranks[rows], side="right") - 1
                sequence[rows], offset[rows] = begin[which] + ranks[rows] - first[which], place[which]
            yield [*batch.columns[:-1], sequence, offset]
        return run

    from pyspark.sql.types import LongType, StructType

    return map_arrow(ranked, make, StructType(kind.fields).add("sequence_id", LongType()).add("offset", LongType()))


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of ``documents``.

    See :func:`token_pieces` for pieces and :func:`pack` for places. Rows that repeat a ``doc_id``
    or lack one are documents of their own; other columns are ignored; no rows give none.
    """
    return pack(token_pieces(docs, capacity, vocabulary), capacity)


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``sequence_id, ids``: the token ids of every sequence, its pieces in order of offset.

    A sequence has at most ``capacity`` ids, so a group is bounded.
    """
    placed = pack(token_pieces(docs, capacity, vocabulary, with_ids=True), capacity)
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
