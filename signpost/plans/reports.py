"""Quality reports as tables: metrics and violations of each catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost import schemas as S
from signpost import vocabulary as V
from signpost.functions.text import is_missing
from signpost.operators import quality as Q
from signpost.sources.files import vocabulary_table


def guidance_violations(
    guidance: DataFrame, facilities: DataFrame, manifest: DataFrame,
    geography_code: str = V.CITY_GEOGRAPHY_CODE,
    sections=V.SECTION_CATEGORIES, detail=V.DETAIL_PAGE_CATEGORIES, hub_url: str = V.GUIDANCE_HUB_URL,
) -> DataFrame:
    spark = guidance.sparkSession
    expected = vocabulary_table(spark, [(c,) for c in sorted({c for _, c in sections})], ["category"])
    pages = vocabulary_table(spark, [(hub_url,), *[(u,) for u, _ in detail]], ["source_page_url"])
    return Q.union_all([
        Q.set_mismatch(guidance, expected, "category", "guidance_category_mismatch"),
        Q.not_unique(guidance, "record_id", "guidance_id_repeated"),
        Q.broken_rules(Q.with_listed(guidance, "source_page_url", pages), "record_id", {
            "guidance_source_missing": (is_missing("source_page_url"), F.lit("source_page_url")),
            "page_not_allowlisted": (F.col("deep_parsed") & ~F.col("_listed"), F.col("source_page_url")),
        }),
        Q.not_unique(facilities, "facility_id", "facility_id_repeated"),
        Q.broken_rules(facilities, "facility_id", {
            "facility_outside_city": (~F.coalesce(F.col("csd_uid") == geography_code, F.lit(False)), F.col("csd_uid")),
            "coordinates_missing": (Q.without_place(), F.lit("")),
        }),
        Q.fetch_failures(manifest),
    ])


def guidance_metrics(guidance: DataFrame, queue: DataFrame, facilities: DataFrame) -> DataFrame:
    linked = ~is_missing("linked_resource_url")
    return Q.union_all([
        Q.single_values(guidance, "guidance", {
            "records": F.count("*"),
            "source_pages": F.count_distinct("source_page_url"),
            "deep_source_pages": Q.distinct_when(F.col("deep_parsed"), "source_page_url"),
            "linked_resources": Q.distinct_when(linked, "linked_resource_url"),
            "duplicate_ids": Q.duplicate_count("record_id"),
        }),
        Q.counts_by(guidance, "category", "guidance_category"),
        Q.missing_values(guidance, S.GUIDANCE_FIELDS, "guidance_missing"),
        Q.single_values(queue, "review_queue", {"records": F.count("*")}),
        Q.single_values(facilities, "facilities", {
            "records": F.count("*"),
            "without_coordinates": Q.without_coordinates(),
            "duplicate_ids": Q.duplicate_count("facility_id"),
        }),
        Q.counts_by(facilities, "normalized_facility_type", "facility_type"),
        Q.missing_values(facilities, S.FACILITY_FIELDS, "facility_missing"),
    ])


def navigator_violations(candidates: DataFrame, structured: DataFrame) -> DataFrame:
    empty = Q.empty_fields(["source_url", "service_name"])
    return Q.union_all([
        Q.not_unique(candidates, "record_id", "candidate_id_repeated"),
        Q.broken_rules(Q.with_listed(candidates, "source_id", structured), "record_id", {
            "candidate_field_missing": (empty != "", empty),
            "source_not_structured": (~F.col("_listed"), F.col("source_id")),
        }),
    ])


def navigator_metrics(candidates: DataFrame, samples: DataFrame, inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    own = F.col("own_organisation")
    return Q.union_all([
        Q.single_values(candidates, "candidates", {
            "records": F.count("*"),
            "own_records": F.count_if(own),
            "own_sources": Q.distinct_when(own, "source_id"),
            "duplicate_ids": Q.duplicate_count("record_id"),
        }),
        Q.single_values(samples, "samples", {"records": F.count("*")}),
        Q.single_values(inventory, "inventory", {
            "sources": F.count("*"),
            "approved": F.count_if(F.col("scope_status") == "approved"),
            "candidates": F.count_if(F.col("scope_status") == "candidate"),
        }),
        Q.counts_by(inventory.where("scope_status = 'approved'"), "execution_status", "approved_status"),
        Q.single_values(manifest, "fetches", {**Q.success_ratio(), "failed": F.count_if(~is_missing("error"))}),
        Q.counts_by(candidates, "category", "candidate_category"),
        Q.counts_by(candidates, "source_id", "candidate_source"),
        Q.missing_values(candidates, S.CANDIDATE_FIELDS, "candidate_missing"),
    ])


def useful_metrics(records: DataFrame) -> DataFrame:
    return Q.union_all([
        Q.single_values(records, "useful", {
            "records": F.count("*"),
            "categories": F.count_distinct("category"),
            "source_ok": F.count_if(F.col("source_http_status") == 200),
            "next_step_ok": F.count_if(F.col("next_step_http_status") == 200),
        }),
        Q.missing_values(records, S.USEFUL_RECORD_FIELDS, "useful_missing"),
    ])


def sample_metrics(samples: DataFrame) -> DataFrame:
    return Q.union_all([
        Q.single_values(samples, "parse_samples", {
            "urls": F.count("*"),
            "parseable": F.count_if("parseable"),
            "failed": F.count_if(~F.col("parseable")),
            "min_chars": F.min(F.when(F.col("parseable"), F.col("parsed_sample_chars"))),
            "max_chars": F.max(F.when(F.col("parseable"), F.col("parsed_sample_chars"))),
        }),
        Q.counts_by(samples, "sample_type", "sample_type"),
    ])


def sample_violations(samples: DataFrame) -> DataFrame:
    """URLs without a parse sample."""
    return Q.not_matching(
        samples, "source_id", F.col("parseable"),
        F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("No parseable content found.")), "url_not_parseable")
