"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signpost.llm.common import WORD, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 1 << 16
FAN = 1 << 10


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from rows with ``source`` and ``size``.

    Sources take the weights in turn, by code point, null last. They share ``share`` times all
    sizes by weight; a target stops at ``limit`` times its source's size, and what is over is
    shared again by weight until none is above. That end is the level at which, with sources in
    order of size over weight, those below it are full and the others get level times weight.
    """
    if share > limit:
        raise ValueError("the sources cannot give this share within their limits")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sources.select("*", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double").alias("weight"))
    cap = F.col("source_size") * F.lit(float(limit))
    by_level = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    full = F.coalesce(F.sum(cap).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    leveled = ranked.select(
        "*", cap.alias("cap"),
        ((F.sum("source_size").over(whole) * F.lit(float(share)) - full) / rest).alias("level"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level"))))
    return leveled.select(
        "source", "source_size",
        F.least(F.col("cap"), F.coalesce(level.over(whole)["level"], F.lit(float("inf"))) * F.col("weight")).alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard: rows are sources, columns shards, sums exact.

    Each node of the tree gives its left half of the shards their share of its blocks, drawn
    without replacement over all its sources; the right half gets the others. A node's draw
    depends on the seed and its place alone.
    """
    out = np.zeros((len(quotas), shards), np.int64)
    stack = [(0, shards, np.asarray(quotas, np.int64))]
    while stack:
        low, high, held = stack.pop()
        if high - low == 1:
            out[:, low] = held
            continue
        middle = (low + high) // 2
        count = int(held.sum()) * (middle - low) // (high - low)
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(held, count, method="marginals")
        stack += [(low, middle, draw), (middle, high, held - draw)]
    return out


def mix_draws(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, limit: float = 2.0,
    shards: int = 16, block_words: int = BLOCK_WORDS, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """``(sized, plan)``: the rows' sizes and places, and per source what the mix takes of it.

    A source's rows are permuted by a hash of the seed, ``doc_id`` and size, and cut by ranges of
    that hash into blocks of about ``block_words``. The mix takes the source as often as its
    target holds it whole (``passes``), then the blocks of the permuted order from the first, the
    last one up to ``last_hash``; of the rows there, ``part`` words each, so that the words taken
    meet the target but for less than the rows of one hash. The last block is found by sums of
    narrowing hash ranges, never by a running sum over a source. Its block draws, passes in
    turn, are the quota that the splitting tree divides among ``shards``; ``cuts`` holds the
    first draw of each shard.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    slim = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
        .withColumn("hash", _place("doc_id", "size", seed)), "sizes")
    targets = source_targets(slim, weights, share, limit).select(
        "source", "source_size", "target",
        F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).alias("passes"),
        F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / block_words).alias("blocks"))
    targets = written(targets.select("*", (F.floor(F.col("target") + 0.5).cast("long") - F.col("passes") * F.col("source_size")).alias("left")), "targets")
    sized = _with_source(slim, targets.select("source", "blocks")).select(
        "doc_id", "source", "size", "hash", _block("hash", "blocks").alias("block"))

    found = targets.select("source", "left", F.lit(0).cast("long").alias("at"))
    keys = [F.expr(f"block div {FAN}"), F.col("block"), F.col("hash")]
    for step, key in enumerate(keys):
        inside = _with_source(sized, found.select("source", F.col("left").alias("to_take"), F.col("at").alias("parent")))
        if step:
            inside = inside.where(keys[step - 1] == F.col("parent"))
        sums = inside.groupBy("source", "to_take", key.alias("at")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        before = F.coalesce(F.sum("words").over(
            Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # The last child that starts before the words to take are met.
        held = sums.select("source", "at", "rows", (F.col("to_take") - before).alias("left")).where("left > 0")
        found = written(held.groupBy("source").agg(F.max_by(F.struct("at", "left", "rows"), "at").alias("last")).select("source", "last.*"), "found")
        if step == 1:
            blocks = found.select("source", F.col("at").alias("last_block"))
    ends = _with_source(blocks, found.select("source", F.col("at").alias("last_hash"), F.expr("left div rows").alias("part")))
    plan = _with_source(targets, ends, "left").select(
        "source", "source_size", "target", "passes", "blocks", "last_block", "last_hash", F.coalesce("part", F.lit(0)).alias("part"),
        (F.col("passes") * F.col("blocks") + F.coalesce(F.col("last_block") + 1, F.lit(0))).alias("quota"))

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", na_position="last", kind="stable")
        split = split_quotas(rows["quota"].to_numpy(), shards, seed)
        first = np.cumsum(split, axis=1) - split
        return pd.DataFrame({"source": rows["source"].to_numpy(), "cuts": list(first)})

    cuts = plan.select("source", "quota").groupBy().applyInPandas(tree, "source string, cuts array<long>")
    return sized, written(_with_source(plan, cuts), "plan")


def _place(doc_id: str, size: str, seed: int):
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.col(size))


def _block(hash_column: str, blocks: str):
    """Block of a hash: its high 31 bits as a fraction, times the number of blocks."""
    return F.shiftright(F.shiftrightunsigned(hash_column, 33) * F.col(blocks), 31)


def _with_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, left.source.eqNullSafe(right._source), how).drop("_source")


def _draws():
    """The passes of a row: ``(shard, words)`` each, from the columns of a plan."""
    drawn = F.expr(
        "transform(sequence(0L, passes), p -> named_struct('draw', p * blocks + block, 'words', "
        "  case when p < passes then size when last_block is null or block > last_block then 0L "
        "  when block < last_block or hash < last_hash then size when hash = last_hash then least(size, part) else 0L end))")
    taken = F.filter(drawn, lambda d: d["words"] > 0)
    return F.transform(taken, lambda d: F.struct(
        (F.size(F.filter(F.col("cuts"), lambda c: c <= d["draw"])) - 1).alias("shard"), d["words"].alias("words")))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``draws`` of every row of ``documents``.

    ``size`` counts the words of the text (0 for a null one), ``taken`` the words the mix takes
    of it, repeats counted, and ``draws`` has the output shard and words of each. Sources of no
    words have the target 0. Rows without a source are a source of their own. Repeated rows of one
    ``doc_id`` and size share one place and are taken alike. The result is empty for an empty table
    and the same for every run; other columns are ignored. Options are those of :func:`mix_draws`.
    """
    sized, plan = mix_draws(docs, **how)
    drawn = _with_source(sized.drop("source_size"), plan).select("*", _draws().alias("draws"))
    words = F.aggregate("draws", F.lit(0).cast("long"), lambda total, d: total + d["words"])
    return drawn.select("doc_id", "size", "source_size", "target", words.alias("taken"), "draws")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of ``documents``, a row for every time it is taken.

    Rows lie in their output shard, in an order drawn anew for each shard and pass. A row taken in
    part, one of a source, has its first words only,
    space-joined. Rows that the mix takes nothing of are absent.
    """
    seed = how.get("seed", 7)
    _, plan = mix_draws(docs, **how)
    source, text = F.col("row.source").cast("string"), F.col("row.text").cast("string")
    packed = docs.select(F.struct("*").alias("row")).select(
        "row", source.alias("source"), F.col("row.doc_id").cast("long").alias("id"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    placed = _with_source(packed.withColumn("hash", _place("id", "size", seed)), plan)
    placed = placed.withColumn("block", _block("hash", "blocks"))
    drawn = placed.select("row", "hash", "size", F.posexplode(_draws()).alias("pass", "draw"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(WORD), F.lit(0)), 1, F.col("draw.words").cast("int")), " ")
    cut = F.when(F.col("draw.words") < F.col("size"), first)
    fields = [F.coalesce(cut, F.col("row.text").cast("string")).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    order = F.xxhash64(F.lit(seed + 1), "hash", "pass")
    return drawn.select(F.col("draw.shard").alias("_shard"), order.alias("_order"), F.struct(*fields).alias("_row")).repartitionByRange(
        "_shard", "_order").sortWithinPartitions("_shard", "_order").select("_row.*")
