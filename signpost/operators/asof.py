"""As-of join: for every row the latest row of a history that was in force at its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signpost.session import written


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, since: str,
               tie: Sequence[str] = (), into: str = "in_force") -> DataFrame:
    """Every row of ``left`` with ``into``: the latest row of ``right`` with its keys and ``since <= at``.

    ``into`` is a struct of all columns of ``right``, null where no such row is; of rows of one time the
    one greatest in ``tie`` counts. Null keys match nothing, nor does a null time on either side.

    Both sides are put in one order of keys and time, in range partitions, so that a key of very many
    rows is split by time. Within a partition the latest row is filled forward; what a partition
    inherits from those before it is one row, found over the last rows of partitions.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = [F.col(k).alias(n) for k, n in zip(keys, names)]
    known = right.dropna(subset=[*keys, since]).select(
        *keyed, F.col(since).alias("_time"), F.lit(0).alias("_side"), F.struct(F.lit(0), *tie).alias("_tie"),
        F.struct(*right.columns).alias("_right"))
    asked = left.select(
        *keyed, F.col(at).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    both = known.unionByName(asked, allowMissingColumns=True)
    placed = written(both.orderBy(*names, "_time", "_side", "_tie").select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "as_of")
    here = Window.partitionBy("_part", *names).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = placed.withColumn("_here", F.last("_right", ignorenulls=True).over(here)).where("_side = 1")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    ends = placed.groupBy("_part").agg(F.max_by(
        F.struct(*names, "_right"), F.when(F.col("_side") == 0, F.col("_row"))).alias("_end"))
    inherited = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    same = F.lit(True)
    for name in names:
        same = same & (F.col(name) == F.col("_before")[name])
    found = F.coalesce("_here", F.when(same, F.col("_before")["_right"]))
    # A row without a time stands before all others of its key.
    return filled.join(inherited, "_part").select("_left.*", F.when(F.col("_time").isNotNull(), found).alias(into))
