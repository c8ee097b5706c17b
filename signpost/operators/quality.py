"""Counts, missingness and coverage of a table, and constraints as rows of violations.

Metrics come out as ``section, key, value`` and violations as ``rule, key, detail`` so that any
number of checks unions into one table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.functions.text import blank, is_missing

Key = Column | str


def _name(key: Key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# -- metrics ---------------------------------------------------------------------------------


def counts_by(df: DataFrame, key: Key, section: str) -> DataFrame:
    """Rows per value of ``key``."""
    return df.groupBy(_name(key).alias("key")).agg(F.count("*").alias("value")).select(
        F.lit(section).alias("section"), blank(F.col("key").cast("string")).alias("key"), "value"
    )


def single_values(df: DataFrame, section: str, values: Mapping[str, Column]) -> DataFrame:
    """Several aggregates in one pass, one output row each."""
    row = df.agg(*[v.cast("bigint").alias(k) for k, v in values.items()])
    return row.select(
        F.explode(F.map_from_arrays(
            F.array(*[F.lit(k) for k in values]), F.array(*[F.coalesce(F.col(k), F.lit(0)) for k in values])
        )).alias("key", "value")
    ).select(F.lit(section).alias("section"), "key", "value")


def missing_values(df: DataFrame, fields: Sequence[str], section: str) -> DataFrame:
    """Missing (null or empty) values per field, in one pass over the table."""
    return single_values(df, section, {
        f: F.count_if(is_missing(F.col(f).cast("string"))) for f in fields
    })


def distinct_when(condition: Column, key: Key) -> Column:
    """Aggregate: distinct keys among the rows that meet the condition."""
    return F.count_distinct(F.when(condition, _name(key)))


def duplicate_count(key: Key) -> Column:
    """Aggregate: rows minus distinct keys."""
    return F.count("*") - F.count_distinct(blank(_name(key).cast("string")))


def without_coordinates(latitude: str = "latitude", longitude: str = "longitude") -> Column:
    return F.count_if(
        is_missing(F.col(latitude).cast("string")) | is_missing(F.col(longitude).cast("string")))


def success_ratio(status: Key = "http_status", ok: int = 200) -> dict[str, Column]:
    return {"succeeded": F.count_if(_name(status) == ok), "total": F.count("*")}


def sample_lengths(length: str = "parsed_sample_chars", parseable: str = "parseable") -> list[Column]:
    """Aggregates: mean, shortest and longest retained sample."""
    kept = F.when(F.col(parseable), F.col(length))
    return [F.avg(kept).alias("mean_chars"), F.min(kept).alias("min_chars"), F.max(kept).alias("max_chars")]


# -- violations ------------------------------------------------------------------------------


def _violations(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), blank(key.cast("string")).alias("key"),
        blank(detail.cast("string")).alias("detail"),
    )


def broken_rules(df: DataFrame, key: str, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """All rules on single rows of a table in one pass: for each rule, whether a row breaks it and the detail.

    A rule whose outcome is unknown is not broken; say so in its condition where it should be.
    """
    found = F.array(*(
        F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(rule).alias("rule"), blank(detail.cast("string")).alias("detail")))
        for rule, (broken, detail) in rules.items()))
    rows = df.select(blank(F.col(key).cast("string")).alias("key"), F.inline(F.filter(found, lambda v: v.isNotNull())))
    return rows.select("rule", "key", "detail")


def empty_fields(fields: Sequence[str]) -> Column:
    """The names of a row's empty fields, comma-joined."""
    return F.concat_ws(",", *[F.when(is_missing(F.col(f).cast("string")), F.lit(f)) for f in fields])


def without_place() -> Column:
    return is_missing(F.col("latitude").cast("string")) | is_missing(F.col("longitude").cast("string"))


def with_listed(df: DataFrame, value: str, allowed: DataFrame) -> DataFrame:
    """The rows with ``_listed``, whether ``value`` is in ``allowed``'s column of that name."""
    known = allowed.select(value).distinct().withColumn("_known", F.lit(True))
    return df.join(known, value, "left").withColumn("_listed", F.col("_known").isNotNull()).drop("_known")


def set_mismatch(observed: DataFrame, expected: DataFrame, key: str, rule: str) -> DataFrame:
    """Values on one side only, with the side that has them."""
    left = observed.select(key).distinct().withColumn("_seen", F.lit(True))
    right = expected.select(key).distinct().withColumn("_wanted", F.lit(True))
    joined = left.join(right, key, "full_outer").where(
        F.col("_seen").isNull() | F.col("_wanted").isNull())
    detail = F.when(F.col("_seen").isNull(), "expected only").otherwise("observed only")
    return _violations(joined, rule, F.col(key), detail)


def not_unique(df: DataFrame, key: str, rule: str) -> DataFrame:
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return _violations(repeated, rule, F.col(key), F.col("n"))


def required_empty(df: DataFrame, key: str, fields: Sequence[str], rule: str) -> DataFrame:
    """Rows with an empty required field; the detail lists the fields."""
    return _violations(df.withColumn("_empty", empty_fields(fields)).where(F.col("_empty") != ""), rule, F.col(key), F.col("_empty"))


def not_matching(df: DataFrame, key: str, condition: Column, detail: Key, rule: str) -> DataFrame:
    """Rows that fail a condition (an unknown outcome fails)."""
    return _violations(df.where(~F.coalesce(condition, F.lit(False))), rule, F.col(key), _name(detail))


def not_listed(df: DataFrame, key: str, value: str, allowed: DataFrame, rule: str) -> DataFrame:
    """Rows whose ``value`` is not in ``allowed``'s column of that name."""
    outside = df.join(allowed.select(value), value, "left_anti")
    return _violations(outside, rule, F.col(key), F.col(value))


def fetch_failures(manifest: DataFrame, key: str = "url", rule: str = "fetch_failed") -> DataFrame:
    return _violations(manifest.where(~is_missing("error")), rule, F.col(key), F.col("error"))


def coordinates_missing(df: DataFrame, key: str, rule: str = "coordinates_missing") -> DataFrame:
    return _violations(df.where(without_place()), rule, F.col(key), F.lit(""))
