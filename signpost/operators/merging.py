"""Distinct counts that merge: exact bitmaps over dense ids, stored once per load.

A load's bitmaps are kept as a table; the count over several loads joins their bits and reads no load
again. A bitmap holds 32 768 ids in 4 KB, so ids should be dense: :func:`extended_ids` numbers values
in the order of their loads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.operators.ordering import with_position
from signpost.session import written


def extended_ids(known: DataFrame | None, rows: DataFrame, value: str, id: str = "id") -> DataFrame:
    """``value, id``: the known numbers, and the next ones for values of ``rows`` that have none yet.

    Null is no value. Numbers begin at 1, never change and leave no gaps; one number, the greatest
    known, comes to the driver. The result is written, so that later reads agree.
    """
    values = rows.select(value).where(F.col(value).isNotNull()).distinct()
    if known is None:
        return written(with_position(values, [value], id).select(value, id), "ids")
    top = known.agg(F.max(id)).first()[0] or 0
    fresh = with_position(values.join(known, value, "left_anti"), [value], id)
    return written(known.select(value, id).unionByName(fresh.select(value, (F.col(id) + top).alias(id))), "ids")


def with_ids(rows: DataFrame, ids: DataFrame, value: str) -> DataFrame:
    """``rows`` with the number of their value, null where it has none."""
    return rows.join(ids, value, "left")


def distinct_parts(rows: DataFrame, keys: Sequence[str], id: str) -> DataFrame:
    """``*keys, bucket, bits, rows``: the ids of every key as bitmaps, and how many rows went in.

    Rows without an id set no bit but keep their key, so that a key of none counts 0.
    """
    bucket = F.when(F.col(id).isNotNull(), F.bitmap_bucket_number(F.col(id).cast("long"))).alias("bucket")
    position = F.bitmap_bit_position(F.col(id).cast("long"))
    return rows.select(*keys, bucket, position.alias("_at")).groupBy(*keys, "bucket").agg(
        F.bitmap_construct_agg("_at").alias("bits"), F.count("*").alias("rows"))


def merged_parts(*loads: DataFrame) -> DataFrame:
    """The bitmaps of several loads as those of their union."""
    every = loads[0]
    for load in loads[1:]:
        every = every.unionByName(load)
    keys = [c for c in every.columns if c not in ("bits", "rows")]
    return every.groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("rows").alias("rows"))


def distinct_totals(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``*keys, values, rows``: distinct ids and rows of every key, from bitmaps alone."""
    counted = F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits")).otherwise(0)
    return merged_parts(parts).groupBy(*keys).agg(F.sum(counted).alias("values"), F.sum("rows").alias("rows"))
