"""Nearest neighbours by inner product through a forest of sorted hash prefixes."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost.llm.common import map_arrow, written
from signpost.llm.vectors import dimension, is_usable, matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 24
BITS = 32
GROUP_ROWS = 4_096
MISS = 0.05


def stop_level(cosine: float, trees: int, miss: float) -> int:
    """The longest prefix at which a vector of this cosine is missed in all trees with at most this probability.

    Each hash bit of two vectors agrees with probability 1 - angle / pi.
    """
    agree = 1.0 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    needed = 1.0 - miss ** (1.0 / trees)
    return BITS if agree >= 1.0 else min(BITS, int(math.log(needed) / math.log(agree))) if agree > 0 else 0


def _hashed(rows: DataFrame, greatest: float | None, trees: int, size: int, seed: int) -> DataFrame:
    """Rows (``key, ids, embedding``) once per tree, with their hash strings of ``BITS`` random signs.

    With ``greatest``, the greatest norm, a vector is extended to that norm, so that the angle to
    a query (extended by 0) falls as their inner product grows.
    """
    def make():
        planes = np.random.default_rng(seed).standard_normal((size + 1, trees * BITS))
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)

        def run(batch: pa.RecordBatch):
            if not batch.num_rows:
                return
            x = matrix(batch.column(2))
            scale = greatest or np.abs(x).max(axis=1, keepdims=True)
            x = x / scale
            more = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1))) if greatest else np.zeros(len(x))
            for at in range(0, len(x), 1024):
                part = slice(at, at + 1024)
                signs = (np.column_stack([x[part], more[part]]) @ planes > 0).reshape(-1, trees, BITS)
                codes = signs.astype(np.int64) @ weights
                for t in range(trees):
                    n = len(codes)
                    yield [np.full(n, t, np.int32), codes[:, t], *(c.slice(at, n) for c in batch.columns)]
        return run

    return map_arrow(rows.select("key", "ids", "embedding"), make, "tree int, code long, key long, ids array<long>, embedding array<double>")


def _visit(k: int, trees: int, floor: int, miss: float, greatest: float):
    """Of each query's visits to a group, the nearest rows found there.

    The group's hash strings are sorted. A query descends to the longest prefix that holds ``k``
    rows, and ascends from there, to the prefix at which those it has found are good enough to
    expect no more (or to the group's own prefix).
    """
    kind = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    masks = np.array([((1 << level) - 1) << (BITS - level) for level in range(BITS + 1)], np.int64)

    def run(index: pa.Table, visits: pa.Table) -> pa.Table:
        if not index.num_rows or not visits.num_rows:
            return kind.empty_table()
        index, visits = index.combine_chunks(), visits.combine_chunks()
        codes = index["code"].to_numpy()
        order = np.argsort(codes, kind="stable")
        codes, rows = codes[order], matrix(index["embedding"].combine_chunks())[order]
        lists = index["ids"].combine_chunks()
        begins, ids = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
        queries = matrix(visits["embedding"].combine_chunks())
        lengths = np.sqrt((queries * queries).sum(axis=1))
        out = ([], [], [])
        for own, query, length, code in zip(visits["key"].to_numpy(), queries, lengths, visits["code"].to_numpy()):
            low = np.searchsorted(codes, code & masks, side="left")
            high = np.searchsorted(codes, (code & masks) | ~masks & ((1 << BITS) - 1), side="right")
            enough = np.flatnonzero(high - low > k)
            level = int(enough[-1]) if len(enough) and enough[-1] > floor else floor
            while True:
                scores = rows[low[level]:high[level]] @ query
                found = np.partition(scores, -k)[-k] if len(scores) >= k else -math.inf
                # The ascent from here: to where the k-th found so far would be met in some tree.
                wanted = max(floor, stop_level(found / (length * greatest), trees, miss)) if found > -math.inf else floor
                if wanted >= level:
                    break
                level = wanted
            near = np.flatnonzero(scores >= found) if len(scores) > k else np.arange(len(scores))
            # Added one component after another, as in a plain loop.
            true = np.cumsum(rows[low[level] + near] * query, axis=1)[:, -1]
            for i, score in zip(order[low[level] + near].tolist(), true.tolist()):
                for vec_id in ids[begins[i]:begins[i + 1]].tolist():
                    if vec_id != own:
                        out[0].append(own)
                        out[1].append(vec_id)
                        out[2].append(score)
        return pa.table([pa.array(x, f.type) for x, f in zip(out, kind)], schema=kind)

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, trees: int = TREES, group_rows: int = GROUP_ROWS,
            miss: float = MISS, seed: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its ``k`` nearest other rows found.

    ``queries`` says which rows of ``embeddings`` (``vec_id, embedding``) are queries; candidates
    are all rows of another ``vec_id``. Nearness is the inner product in double precision, ties
    go to the smaller ``vec_id``. All candidates are returned where they are fewer than ``k``.

    Every distinct vector has a hash string in each tree. A tree's strings lie in groups by
    their first bits, about ``group_rows`` in each, in sorted order within; the rows of a
    group of very many, and the queries that visit it, are dealt into chunks that meet in tasks
    of their own. A query first visits the group
    of its own prefix in every tree. All trees then go up together, a bit a round, to the groups
    beside those seen, for the queries whose k-th neighbour so far is not near enough: where a
    vector as near as that would be missed in all trees with a probability above ``miss``. At the
    empty prefix all rows have been seen, so the search has no cap on candidates.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without
    a ``vec_id``, take no part. Rows that repeat a ``vec_id`` and a vector are one; with several
    vectors, an id is a query with each and is listed once per score. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), queries.alias("asks"))
    rows = rows.where(is_usable() & F.col("vec_id").isNotNull())
    rows = written(rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0))).distinct(), "vectors")
    size = dimension(rows)
    if not size:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Of one vector's rows, more than k + 1 ids can never be needed.
    least = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.select("vec_id", "embedding").distinct().withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    classes = first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("key", F.monotonically_increasing_id())
    classes = written(classes, "classes")
    total, greatest = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)))).first()
    # The norms of rows as numpy adds them may be greater in the last places.
    greatest *= 1 + 1e-12
    depth = min(BITS, max(0, math.ceil(math.log2(total / group_rows))))
    prefix = F.shiftrightunsigned("code", BITS - depth)

    placed = written(_hashed(classes, greatest, trees, size, seed).withColumn("prefix", prefix), "index")
    counts = placed.groupBy("tree", "prefix").agg(F.ceil(F.count("*") / (2 * group_rows)).cast("int").alias("chunks"))
    counts = written(counts, "groups")
    asked = rows.where("asks").select(F.col("vec_id").alias("key"), F.array().cast("array<long>").alias("ids"), "embedding")
    asked = written(_hashed(asked, None, trees, size, seed).drop("ids").withColumn("prefix", prefix), "queries")

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best, active = None, asked
    for level in range(depth, -1, -1):
        # The groups that share the first ``level`` bits with the query's, but not the next one.
        if level == depth:
            there = F.array("prefix")
        else:
            span = depth - level - 1
            there = F.expr(f"transform(sequence(0L, {(1 << span) - 1}L), i -> shiftleft(shiftright(prefix, {span}) ^ 1L, {span}) + i)")
        visits = active.select("tree", "code", "key", "embedding", F.explode(there).alias("prefix"))
        # A group's rows are dealt into chunks and its visits into parts; each chunk meets each part.
        met = visits.groupBy("tree", "prefix").agg(F.ceil(F.count("*") / (2 * group_rows)).cast("int").alias("parts"))
        met = written(met.join(counts, ["tree", "prefix"]), "met")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one_of = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
        group = ("tree", "prefix", "chunk", "part")
        visits = visits.join(met, ["tree", "prefix"]).select(
            "tree", "prefix", "code", "key", "embedding", one_of("parts").alias("part"), every("chunks").alias("chunk"))
        index = placed.join(met, ["tree", "prefix"]).select(
            "tree", "prefix", "code", "key", "ids", "embedding", one_of("chunks").alias("chunk"), every("parts").alias("part"))
        found = index.groupBy(*group).cogroup(visits.groupBy(*group)).applyInArrow(
            _visit(k, trees, level, miss, greatest), "query long, vec_id long, score double")
        found = found.unionByName(best.select("query", "vec_id", "score")) if best is not None else found
        best = written(found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        if not level:
            break
        # The k-th score at which this level is enough; a query with fewer found or a lesser one goes on.
        agree = (1.0 - miss ** (1.0 / trees)) ** (1.0 / level)
        cosine = math.cos(math.pi * (1.0 - agree))
        last = best.where(F.col("rank") == k).select(F.col("query").alias("key"), F.col("score").alias("last"))
        length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)) * greatest
        active = written(active.join(last, "key", "left").where(F.coalesce(F.col("last"), F.lit(float("-inf"))) < length * cosine).select(
            "tree", "code", "key", "embedding", "prefix"), "active")
        if active.isEmpty():
            break
    return best.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_to_every(vectors: DataFrame, every: int = 20, k: int = 20, **how) -> DataFrame:
    """:func:`nearest` for the rows whose ``vec_id`` is divisible by ``every``."""
    return nearest(vectors, F.coalesce(F.col("vec_id") % every == 0, F.lit(False)), k, **how)
