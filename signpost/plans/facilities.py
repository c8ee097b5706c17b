"""Facility directory of one city and the nested counts around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schemas as S
from signpost import vocabulary as V
from signpost.functions.text import blank, casefold, clean_text, digest, natural_key

# -- fixed values: source column of each cleaned output column ---------------------------------
CLEANED = (
    ("facility_name", "facility_name"),
    ("source_facility_type", "source_facility_type"),
    ("normalized_facility_type", "odhf_facility_type"),
    ("provider", "provider"),
    ("unit", "unit"),
    ("street_no", "street_no"),
    ("street_name", "street_name"),
    ("postal_code", "postal_code"),
    ("city", "city"),
    ("province", "province"),
    ("source_formatted_address", "source_format_str_address"),
    ("csd_name", "CSDname"),
)
AS_IS = (("csd_uid", "CSDuid"), ("province_uid", "Pruid"), ("latitude", "latitude"), ("longitude", "longitude"))


def facility_order() -> list[Column]:
    return [casefold("facility_name"), F.col("facility_id")]


def facilities(
    source: DataFrame,
    retrieved_at: Column,
    source_url: str = V.FACILITY_SOURCE_URL,
    geography_code: str = V.CITY_GEOGRAPHY_CODE,
) -> DataFrame:
    """Cleaned rows of one geography code, with a hash that ignores the retrieval time."""
    rows = source.where(F.col("CSDuid") == geography_code).select(
        natural_key("odhf-", "index").alias("facility_id"),
        *[clean_text(blank(raw)).alias(name) for name, raw in CLEANED],
        *[blank(raw).alias(name) for name, raw in AS_IS],
        F.lit(source_url).alias("source_url"),
        retrieved_at.alias("retrieved_at"),
    )
    hashed = [f for f in S.FACILITY_FIELDS if f not in ("retrieved_at", "record_content_hash")]
    return rows.withColumn("record_content_hash", digest(*hashed))


def nested_counts(
    source: DataFrame,
    geography_code: str = V.CITY_GEOGRAPHY_CODE,
    province: str = V.PROVINCE_CODE,
) -> DataFrame:
    """Country, province and city counts in one pass (province folded, city code exact)."""
    return source.agg(
        F.count("*").alias("country_rows"),
        F.count_if(casefold("province") == province).alias("province_rows"),
        F.count_if(F.col("CSDuid") == geography_code).alias("city_rows"),
    )
