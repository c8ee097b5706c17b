"""Contiguous shards of near equal bytes, through global prefix sums. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signpost.llm.common import written


def byte_shards(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """``documents`` in order of ``doc_id``, cut at equal byte targets into shards 0 to ``shards - 1``.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: ``size`` is the UTF-8
    bytes of the text plus ``overhead``, ``slot`` the place in the shard, gapless from 0. A row
    belongs to the shard that its middle byte falls into, so that a shard misses its target by at
    most half a row at either end.

    A null text counts ``overhead`` bytes and has a null checksum. Rows without a ``doc_id`` come
    first; rows of one ``doc_id`` are ordered by checksum and size and may lie in several
    partitions and shards. An empty table gives an empty result; other columns are ignored.

    The text is read once, for its size and checksum. Range partitions of these narrow rows are
    written with their partition number; a partition's total gives where it starts, and a running
    sum within it gives where each row starts. A tie-break by input position splits ids that hold
    many rows. Only totals of partitions and the first rows of shards are in one task.
    """
    text = F.col("text").cast("string")
    slim = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie")), "sizes")
    order = ("doc_id", "text_crc32", "size", "tie")
    placed = written(
        slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "ordered")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    located = placed.select(
        "*", F.sum("size").over(within).alias("upto"), F.count("*").over(within).alias("nth")).join(starts, "part")
    cut = located.select(
        "doc_id", "size", "text_crc32",
        F.expr(f"cast(((2 * (bytes_before + upto) - size) * {int(shards)}L) div (2 * total) as int)").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("position"))
    first = cut.groupBy("shard").agg(F.min("position").alias("first"))
    return cut.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int = 40, overhead: int = 16) -> None:
    """Write ``documents`` as Parquet, one folder ``shard=N`` per shard of :func:`byte_shards`.

    Each row meets its shard by ``doc_id``, checksum and size; rows equal in all three go to the
    first shard of their group together, so none is lost or doubled.
    """
    text = F.col("text").cast("string")
    places = byte_shards(docs, shards, overhead).groupBy("doc_id", "text_crc32", "size").agg(
        F.min("shard").alias("shard")).withColumnRenamed("doc_id", "id")
    packed = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.crc32(text.cast("binary")).alias("crc"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("bytes"))
    met = packed.join(places, packed.id.eqNullSafe(places.id) & packed.crc.eqNullSafe(places.text_crc32)
                      & (packed.bytes == places.size))
    met.select("row.*", "shard").write.partitionBy("shard").parquet(folder)
