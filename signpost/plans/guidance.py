"""Guidance catalogue, its review queue, and the source manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schemas as S
from signpost import vocabulary as V
from signpost.functions.text import blank, casefold, digest, is_missing, or_else, payload_hash, short_id
from signpost.functions.urls import url_host
from signpost.operators import extract as X
from signpost.operators.ordering import last_per_key
from signpost.operators.pages import (
    GUIDANCE_ROOT, GUIDANCE_UPDATED, first_root, parse_pages, with_id, with_page_facts,
)
from signpost.sinks.files import require_clean

PAGE_COLUMNS = ("url", "http_status", "retrieved_at", "error")


def catalogue_order() -> list[Column]:
    return [F.col("category"), F.col("record_type"), casefold("action_title"), F.col("record_id")]


def review_order() -> list[Column]:
    return [F.col("category"), casefold("action_title"), F.col("record_id")]


def manifest_order() -> list[Column]:
    return [F.col("source_type"), F.col("url")]


def _agency_names(vocabulary=V.AGENCIES) -> Column:
    return F.create_map(*[F.lit(x) for pair in vocabulary for x in pair])


def agency_for_url(url: Column) -> Column:
    """Agency of a URL's host, the host itself when it is not listed (a fixed eight-entry lookup)."""
    host = url_host(url)
    return F.coalesce(F.try_element_at(_agency_names(), host), host)


def read_guidance_pages(fetches: DataFrame) -> DataFrame:
    """Parsed pages with the guidance page facts (update prefix removed, no title-element fallback)."""
    readable = fetches.withColumn("html", F.when(is_missing("error"), F.col("html")))
    return with_page_facts(
        parse_pages(readable, PAGE_COLUMNS), GUIDANCE_ROOT, GUIDANCE_UPDATED, True, False
    )


def hub_pages(fetches: DataFrame, hub_url: str = V.GUIDANCE_HUB_URL) -> DataFrame:
    return read_guidance_pages(fetches.where(F.col("url") == hub_url))


def missing_sections(hub: DataFrame, vocabulary=V.SECTION_CATEGORIES) -> DataFrame:
    """Selected sections a hub page lacks: ``url, section``. Any row means the page changed shape."""
    wanted = F.array(*[F.lit(s) for s, _ in vocabulary])
    main = hub.withColumn("sections", X.hub_sections(first_root(with_id("main"))))
    return main.where(F.col("sections").isNotNull()).select(
        "url",
        F.explode(
            F.array_except(wanted, F.transform("sections", lambda h: h["section"]))
        ).alias("section"),
    )


def checked_hub(hub: DataFrame, vocabulary=V.SECTION_CATEGORIES) -> DataFrame:
    """The hub pages, or the end of the run where one lacks a selected section."""
    require_clean(missing_sections(hub, vocabulary))
    return hub


def _records(pages: DataFrame, items: Column, source_rank: int, deep: Column) -> DataFrame:
    rows = pages.select(
        "url", "page_title", "source_last_updated", "retrieved_at", "content_hash",
        F.posexplode(items).alias("position", "item"),
    ).select("*", "item.*")
    linked = F.col("linked_resource_url")
    return rows.select(
        short_id("category", "record_type", "url", "action_title", linked).alias("record_id"),
        "category", "record_type", "action_title", "section",
        F.col("page_title").alias("source_page_title"), F.col("url").alias("source_page_url"),
        "linked_resource_title", "linked_resource_url",
        agency_for_url(or_else(linked, F.col("url"))).alias("linked_resource_agency"),
        deep.alias("deep_parsed"), "source_last_updated", "retrieved_at",
        F.lit(True).alias("requires_human_review"),
        F.col("content_hash").alias("source_content_hash"),
        digest(
            "category", "record_type", "action_title", "section", "url", "linked_resource_title",
            linked, "content_hash",
        ).alias("record_content_hash"),
        F.lit(source_rank).alias("source_rank"), "position",
    )


def hub_records(hub: DataFrame, vocabulary=V.SECTION_CATEGORIES, detail=V.DETAIL_PAGE_CATEGORIES) -> DataFrame:
    """Actions and resources of the selected sections; ``checked_hub`` first ends a run that lacks any."""
    urls = [u for u, _ in detail]
    ready = hub.withColumn("sections", X.hub_sections(first_root(with_id("main"))))
    items = X.hub_items(F.col("sections"), F.col("url"), vocabulary)
    linked = F.col("linked_resource_url")
    return _records(ready, items, 0, F.when(linked != "", linked.isin(*urls)).otherwise(True))


def detail_records(fetches: DataFrame, allowlist: DataFrame, urls=tuple(u for u, _ in V.DETAIL_PAGE_CATEGORIES)) -> DataFrame:
    """Actions and resources of the allowlisted pages; ``allowlist(url, category)``."""
    categories = allowlist.select("url", F.col("category").alias("page_category"))
    readable = fetches.where(F.col("url").isin(*urls))
    pages = read_guidance_pages(readable).join(categories, "url")
    items = X.detail_items(
        F.col("root"), F.col("page_title"), F.col("page_category"), F.col("url"), urls
    )
    return _records(pages, items, 1, F.col("record_type") == "detail_action")


def catalogue(hub: DataFrame, detail: DataFrame) -> DataFrame:
    """Hub and detail records, the last one per record id."""
    return last_per_key(
        hub.unionByName(detail), ["record_id"], ["source_rank", "source_page_url", "retrieved_at", "position"]
    ).drop("source_rank", "position")


def review_queue(catalogue_rows: DataFrame) -> DataFrame:
    """Blank review form per record, status pending."""
    return catalogue_rows.select(
        "record_id", "category", "action_title", "source_page_url", "linked_resource_url",
        *[F.lit("").alias(c) for c in
          ("eligibility", "delivery_format", "plain_language_summary", "safety_notes", "reviewer")],
        F.lit("pending").alias("approval_status"), F.lit("").alias("reviewed_at"),
    ).select(*S.REVIEW_FIELDS)


def page_manifest(pages: DataFrame, source_type: str = "quebec_guidance", deep: bool = True) -> DataFrame:
    """One row per fetch of a guidance page; a parse error shows where the fetch had none."""
    ok = is_missing("error")

    def or_empty(column: str, name: str):
        return F.when(ok, F.col(column)).otherwise(F.lit("")).alias(name)

    return pages.select(
        short_id(F.lit(source_type), "url").alias("source_id"), F.lit(source_type).alias("source_type"),
        "url", or_empty("page_title", "title"),
        F.when(ok, F.col("http_status")).otherwise(0).cast("int").alias("http_status"),
        or_empty("source_last_updated", "source_last_updated"), "retrieved_at",
        or_empty("content_hash", "content_hash"), F.lit(deep).alias("deep_parsed"),
        or_else(blank("error"), blank("parse_error")).alias("error"),
    )


def archive_manifest(archives: DataFrame, source_type: str, title: str) -> DataFrame:
    """Manifest rows of binary downloads ``(url, http_status, retrieved_at, content, error)``."""
    ok = is_missing("error")
    return archives.select(
        short_id(F.lit(source_type), "url").alias("source_id"), F.lit(source_type).alias("source_type"),
        "url", F.when(ok, F.lit(title)).otherwise("").alias("title"),
        F.when(ok, F.col("http_status")).otherwise(0).cast("int").alias("http_status"),
        F.lit("").alias("source_last_updated"), "retrieved_at",
        F.when(ok, payload_hash("content")).otherwise("").alias("content_hash"),
        F.lit(True).alias("deep_parsed"), blank("error").alias("error"),
    )
