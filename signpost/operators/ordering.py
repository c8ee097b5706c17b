"""Order-dependent operators: first/last per key, caps, carry-forward, round-robin samples.

Order is always a data column. Each "keep n per key" is a rank filter, which Spark turns into a
per-task limit before the shuffle: a key holding a third of all rows still sends at most n rows
per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost.functions.text import casefold
from signpost.session import written

Keys = Sequence[Column | str]


def top_per_key(df: DataFrame, keys: Keys, order: Keys, n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key in the given order; ``rank`` keeps the position under that name."""
    name = rank or "_position"
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def first_per_key(df: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def last_per_key(df: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    """Last row per key in input order, as when later rows overwrite earlier ones."""
    reverse = [F.desc(o) if isinstance(o, str) else o.desc() for o in order]
    return top_per_key(df, keys, reverse, 1)


def carry_forward(df: DataFrame, value: Column, keys: Keys, order: Keys, default: Column) -> Column:
    """Latest non-null ``value`` up to and including the current row, else the default."""
    window = (
        Window.partitionBy(*keys).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return F.coalesce(F.last(value, ignorenulls=True).over(window), default)


def round_robin(
    df: DataFrame, group: str, name: str, n: int, order: str, position: str = "sample_position"
) -> DataFrame:
    """One row per group per round, groups in order, ``n`` rows in total.

    A group contributes at most ``n`` rows to the answer, so the rank filter cuts every group
    before the shuffle, and the rounds are then merged as a plain top-n.
    """
    ranked = top_per_key(df, [group], [casefold(name), F.col(order)], n, rank="_round")
    picked = ranked.orderBy("_round", group).limit(n)
    window = Window.orderBy("_round", group)  # over at most n rows
    return picked.withColumn(position, F.row_number().over(window)).drop("_round")


def with_position(df: DataFrame, order: Keys, position: str = "position") -> DataFrame:
    """Every row with its place, from 1, in a total order, without a window over all rows.

    The rows are range-partitioned and sorted, and written with their partition and their place in
    it; a partition begins after the rows of those before it, of which there are few. All columns are
    written: hand in those that are wanted.
    """
    placed = written(df.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "sorted")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first")).select(
        "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(starts, "_part").withColumn(
        position, F.col("_before") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_first", "_before")


def ordered_list(value: Column, order: Column) -> Column:
    """Aggregate: values collected in the given order (for groups bounded by one page or card)."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])
