"""CSV records of files that split at any line: which lines lie within quotes is told by counting quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signpost.functions.text import fix_windows_1252

WESTERN = ("cp1252", "windows-1252")


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``(file, block, line, first, record)``: one row per CSV record, with the line breaks that its quotes hold.

    ``(block, line)`` rises along a file; ``first`` marks a file's first record that is not empty. A line lies
    within quotes where the quotes before it in its file are odd in number. Totals of the file's
    blocks (the ranges that tasks read) give the parity each block begins with, and a running sum
    that of its lines, so a file is read by as many tasks as it has blocks. What is put together is a block's
    lines, and of each block at most the records that cross its two ends.

    A quote belongs to a quoted cell (inches in a cell without quotes would open one). Lines end in
    LF or CRLF, which becomes LF within quotes too. Where the quotes of a file do not pair, all from the odd one on is one record.
    """
    if encoding.lower() not in ("utf-8", "utf8", *WESTERN):
        raise ValueError(f"files in {encoding} cannot be split at lines")
    raw = F.col("value")
    text = fix_windows_1252(F.decode(raw.cast("binary"), "ISO-8859-1")) if encoding.lower() in WESTERN else raw
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), text.alias("value"))
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.translate("value", '"', "")))

    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("held")).select(
        "file", "block", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("opened"))
    whole = Window.partitionBy("file", "block")
    so_far = whole.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.when(~F.col("value").isin("", "\r"), F.col("line"))
    placed = lines.join(blocks, ["file", "block"]).withColumn(
        "after", F.col("opened") + F.sum("quotes").over(so_far)).withColumn(
        "begins", (F.col("after") - F.col("quotes")) % 2 == 0).withColumn(
        "of", F.last(F.when(F.col("begins"), F.col("line")), ignorenulls=True).over(so_far)).withColumn(
        "first", (F.col("block") == 0) & F.coalesce(F.col("line") == F.min(filled).over(whole), F.lit(False)))

    alone = F.col("begins") & (F.col("after") % 2 == 0)
    joined = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct(*order, "value"))), lambda x: x["value"]), "\n").alias("value")
    pieces = placed.where(~alone).groupBy("file", "block", "of").agg(
        joined(["line"]), F.max("first").alias("first"), F.min("line").alias("line"), (F.sum("quotes") % 2).alias("odd"))
    # What a block ends within, and what it begins within, belong together across blocks.
    crosses = F.col("of").isNull() | (F.col("odd") == 1)
    along = Window.partitionBy("file").orderBy("block", "line")
    start = F.when(F.col("of").isNotNull(), F.struct("block", "of"))
    crossing = pieces.where(crosses).withColumn("start", F.last(start, ignorenulls=True).over(along)).groupBy("file", "start").agg(
        joined(["block", "line"]), F.max("first").alias("first")).select(
        "file", F.col("start.block").alias("block"), F.col("start.of").alias("line"), "first", "value")
    records = placed.where(alone).select("file", "block", "line", "first", "value").unionByName(
        pieces.where(~crosses).select("file", "block", F.col("of").alias("line"), "first", "value")).unionByName(crossing)
    record = F.regexp_replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), r"\r\z", "")
    return records.select(
        "file", "block", "line", "first", F.when(F.col("first"), F.ltrim(record, F.lit("﻿"))).otherwise(record).alias("record"),
    ).where("record <> ''")
