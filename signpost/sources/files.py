"""CSV and JSON readers: text columns, empty string for missing."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from signpost import schemas as S
from signpost import vocabulary as V
from signpost.functions.text import fix_windows_1252
from signpost.functions.urls import is_http_url
from signpost.sources.records import WESTERN, csv_records


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    encoding: str = "UTF-8",
    multi_line: bool = True,
    whole_files: bool = False,
    position: str | None = None,
) -> DataFrame:
    """CSV with a header; a byte-order mark is dropped and empty cells become ``''``.

    Files split among tasks. ``multi_line`` allows quoted line breaks, see ``csv_records`` for what
    that asks of the files; rows then come in no order, and ``position`` names a column that holds each
    record's place to sort by. ``whole_files`` reads every file in one task instead, for files whose
    quotes do not pair or whose encoding has no lines of bytes.
    """
    windows = encoding.lower() in WESTERN
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("encoding", "ISO-8859-1" if windows else encoding)
        .option("enforceSchema", False)
    )
    df = reader.csv(path)
    if multi_line and not whole_files:
        df = _parsed(csv_records(spark, path, encoding), df.columns, position)
    elif position is not None:
        raise ValueError("only records that are put together from lines have a position")
    elif windows:
        df = df.select(*[fix_windows_1252(f"`{c}`").alias(c) for c in df.columns])
    if schema is not None:
        place = [] if position is None else [F.col(position)]
        df = df.select(*place, *conformed(df, schema))
    return df.na.fill("")


def _parsed(records: DataFrame, names: Sequence[str], position: str | None) -> DataFrame:
    """Cells of the records by the names of the header, which all files must share."""
    ddl = ", ".join(f"c{i} STRING" for i in range(len(names)))
    cells = F.from_csv("record", ddl, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    rows = records.withColumn("cells", cells)
    # Names the reader made up, for empty or repeated ones, are not those of the file.
    other = F.lit(False)
    for i, name in enumerate(names):
        if not re.search(r"\d$", name):
            other = other | (F.lower(f"cells.c{i}") != name.lower())
    told = F.raise_error(F.concat(F.lit("another header than that of the first file: "), F.col("file"))).cast("boolean")
    kept = rows.where(F.when(F.col("first"), F.when(other, told).otherwise(False)).otherwise(True))
    place = [] if position is None else [F.struct("file", "block", "line").alias(position)]
    return kept.select(*place, *[F.col(f"cells.c{i}").alias(c) for i, c in enumerate(names)])


def conformed(df: DataFrame, schema: StructType) -> list[Column]:
    return [
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the schema by name, in its order; extra columns go, missing ones become null."""
    return df.select(*conformed(df, schema))


def read_json_array(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Files that each hold one JSON array, as text columns. A file is one task."""
    df = spark.read.schema(S.text_schema(fields)).option("multiLine", True).json(path)
    return df.na.fill("")


def read_json_lines(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Files of one JSON object a line, as ``write_json`` writes them, as text columns. Files split."""
    return spark.read.schema(S.text_schema(fields)).json(path).na.fill("")


def read_registry(
    spark: SparkSession, path: str, own_flag: str = "own_organisation", multi_line: bool = True
) -> DataFrame:
    """Source registry; ``own_flag`` names the file's column for the organisation's own sources."""
    df = read_csv(spark, path, multi_line=multi_line).withColumnRenamed(own_flag, "own_organisation")
    return conform(df, S.text_schema(S.REGISTRY_FIELDS)).na.fill("").withColumn(
        "own_organisation", F.lower("own_organisation") == "true"
    )


def read_service_specs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_csv(spark, path, S.text_schema(S.SERVICE_SPEC_FIELDS), multi_line=multi_line)


def vocabulary_table(spark: SparkSession, rows, columns: Sequence[str]) -> DataFrame:
    """A fixed vocabulary as a table that joins send to the other side, whose few values would not spread."""
    schema = StructType().add(columns[0], StringType(), False)
    for name in columns[1:]:
        schema = schema.add(name, StringType())
    return F.broadcast(spark.createDataFrame([tuple(map(str, r)) for r in rows], schema))


def taxonomy(spark: SparkSession) -> DataFrame:
    return vocabulary_table(spark, V.TAXONOMY, ["category_id", "category_label"])


def agencies(spark: SparkSession) -> DataFrame:
    return vocabulary_table(spark, V.AGENCIES, ["host", "agency"])


def section_categories(spark: SparkSession) -> DataFrame:
    return vocabulary_table(spark, V.SECTION_CATEGORIES, ["section", "category"])


def detail_pages(spark: SparkSession) -> DataFrame:
    return vocabulary_table(spark, V.DETAIL_PAGE_CATEGORIES, ["url", "category"])


# -- curated directory ---------------------------------------------------------------------


def check_service_records(records: DataFrame) -> DataFrame:
    """Add ``rejected_because``: null for a valid row, else the names of the failed checks.

    Required fields must be present (an empty text is present). A source URL may be absent, but a
    present one must be a well-formed http(s) URL.
    """
    checks = [
        F.when(F.col(f).isNull(), F.lit(f"missing:{f}")) for f in S.SERVICE_RECORD_REQUIRED
    ] + [
        F.when(
            F.col("official_source_url").isNotNull() & ~is_http_url("official_source_url"),
            F.lit("invalid:official_source_url"),
        )
    ]
    reasons = F.concat_ws(", ", *checks)
    return records.withColumn("rejected_because", F.nullif(reasons, F.lit("")))


def read_service_records(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Curated directory as ``(valid, rejected)``; rejected rows carry the reason."""
    raw = read_csv(spark, path, multi_line=multi_line)
    present = raw.select(*[
        F.when(F.col(f"`{c}`").isin(*V.MISSING_TOKENS), F.lit("")).otherwise(F.col(f"`{c}`")).alias(c)
        for c in raw.columns
    ])
    checked = check_service_records(conform(present, S.SERVICE_RECORDS))
    valid = checked.where(F.col("rejected_because").isNull()).drop("rejected_because")
    return valid, checked.where(F.col("rejected_because").isNotNull())
