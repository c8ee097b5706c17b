"""Navigator tables: service candidates, fetch manifest, source inventory, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schemas as S
from signpost import vocabulary as V
from signpost.functions.text import blank, casefold, is_missing, or_else, short_id
from signpost.operators import extract as X
from signpost.operators.ordering import last_per_key, round_robin, top_per_key
from signpost.operators.pages import (
    NAVIGATOR_ROOT, NAVIGATOR_UPDATED, Test, parse_pages, with_page_facts,
)
from signpost.sources.tables import only_urls, with_fetch_outcome

CAP = 30
SOURCE_COLUMNS = (
    "source_id", "organization", "category", "authority_level", "own_organisation", "url",
    "http_status", "retrieved_at", "error",
)
PAGE_FACTS = ("page_title", "source_last_updated", "content_hash", "items", "parse_error")


def candidate_order() -> list[Column]:
    """Presentation order: the organisation's own sources first."""
    return [~F.col("own_organisation"), F.col("source_id"), casefold("service_name")]


def structured_sources(registry: DataFrame) -> DataFrame:
    """Approved sources whose pages are read as structured HTML."""
    return registry.where(
        (F.col("scope_status") == "approved") & (F.col("extraction_method") == "structured_html")
    )


def extract_items(
    pages: DataFrame,
    keep: Sequence[str] = ("url",),
    organisation: str = "",
    cap: int = CAP,
    heading_tags: Sequence[str] = X.HEADINGS,
    root: Sequence[Test] = NAVIGATOR_ROOT,
) -> DataFrame:
    """Page facts and the capped ``items`` of each page ``(url, html, …)``; one row per page, no shuffle."""
    skip = V.skip_titles(organisation)
    facts = with_page_facts(parse_pages(pages, keep), root, NAVIGATOR_UPDATED)
    title, url = F.col("page_title"), F.col("url")
    picked = facts.withColumns({
        "headings": X.accepted_headings(F.col("root"), skip, heading_tags),
        "links": X.internal_links(F.col("root"), url, skip),
    })
    # The cap counts headings first, so neither list needs more than `cap` entries.
    items = F.slice(
        F.concat(
            X.heading_items(F.col("headings"), title, url, cap, heading_tags[0]),
            X.link_items(F.col("links"), title, cap),
        ), 1, cap,
    )
    return picked.select(
        *keep, "page_title", "source_last_updated", "content_hash", "parse_error",
        F.when(F.col("root").isNotNull(), items).alias("items"),
    )


def extract_sources(registry: DataFrame, fetches: DataFrame, pages: DataFrame, key: str = "url", **options) -> DataFrame:
    """One row per fetch of an approved structured source, with its page facts and capped ``items``.

    ``fetches(url, http_status, retrieved_at, error)``, ``pages(url, html)`` with one page per URL;
    ``options`` as for ``extract_items``. Where sources that share a URL have fetches and pages of their
    own, both carry ``source_id`` and ``key`` names it. Pages are read where they lie, and only what was read from
    them is joined to registry and fetches. Manifest and candidates both read this frame; write or
    persist it when both are wanted.
    """
    sources = structured_sources(registry)
    read = extract_items(only_urls(pages, sources, key), tuple(dict.fromkeys((key, "url"))), **options)
    fetched = sources.join(fetches.select(key, "http_status", "retrieved_at", "error"), key).select(*SOURCE_COLUMNS)
    return with_fetch_outcome(fetched, read, PAGE_FACTS, key)


def candidates(extracted: DataFrame, cap: int = CAP) -> DataFrame:
    """Service candidates, one per record id, with ``position`` = place on the page.

    A source gives at most ``cap`` items, over all its pages in order of their URLs.
    """
    items = extracted.select("*", F.posexplode("items").alias("position", "item"))
    rows = top_per_key(items, ["source_id"], ["url", "position", "retrieved_at"], cap).select("*", "item.*")
    built = rows.select(
        short_id("source_id", "record_type", "service_name", "service_url").alias("record_id"),
        "source_id", "organization", "category", "authority_level", "own_organisation",
        "service_name", "record_type", "section", F.col("page_title").alias("source_page_title"),
        F.col("url").alias("source_url"), "service_url",
        *[F.lit("").alias(c) for c in S.CANDIDATE_BLANKS],
        "source_last_updated", "retrieved_at",
        F.lit(True).alias("requires_human_review"), F.lit("pending").alias("review_status"),
        "content_hash", "position",
    )
    return last_per_key(built, ["record_id"], ["retrieved_at", "position"])


def manifest(extracted: DataFrame) -> DataFrame:
    """One row per fetch; a failed fetch keeps its error and is otherwise blank.

    A page that was fetched and could not be read to its end keeps its facts, with the parse error.
    """
    ok = is_missing("error")

    def or_empty(name: str):
        return F.when(ok, blank(name)).otherwise(F.lit("")).alias(name)

    return extracted.select(
        "source_id", "url",
        F.when(ok, F.col("http_status")).otherwise(0).cast("int").alias("http_status"),
        or_empty("page_title"), or_empty("source_last_updated"), "retrieved_at",
        or_empty("content_hash"),
        F.when(ok, F.coalesce(F.size("items"), F.lit(0))).otherwise(0).alias("records_extracted"),
        or_else(blank("error"), blank("parse_error")).alias("error"),
    )


def inventory(
    registry: DataFrame,
    manifest_rows: DataFrame,
    evidence: DataFrame,
    manifest_location: str = "navigator_source_manifest",
) -> DataFrame:
    """Every registered source with its execution status and where the evidence lies.

    ``evidence(source_id, evidence_path, evidence_exists)``; the last manifest row of a source counts.
    """
    latest = last_per_key(
        manifest_rows.select("source_id", "http_status", "retrieved_at"), ["source_id"],
        ["retrieved_at", "http_status"],
    ).select("source_id", F.col("http_status").alias("_status"))
    joined = registry.join(latest, "source_id", "left").join(evidence, "source_id", "left")
    candidate = F.col("scope_status") == "candidate"
    fetched = F.col("_status").isNotNull()
    local = F.col("evidence_path").isNotNull()
    metadata = F.col("extraction_method") == "metadata_only"
    status = (
        F.when(candidate, "candidate_not_executed")
        .when(fetched & (F.col("_status") == 200), "live_extraction_succeeded")
        .when(fetched, "live_extraction_failed")
        .when(local & F.col("evidence_exists"), "existing_local_evidence")
        .when(local, "local_evidence_missing")
        .when(metadata, "metadata_only_by_design")
        .otherwise("not_executed")
    )
    location = (
        F.when(candidate, "")
        .when(fetched, manifest_location)
        .when(local, F.col("evidence_path"))
        .when(metadata, F.col("url"))
        .otherwise("")
    )
    return joined.withColumns({"execution_status": status, "evidence_location": location}).select(
        *[c for c in S.INVENTORY_FIELDS if c in joined.columns or c in ("execution_status", "evidence_location")]
    )


def review_samples(candidate_rows: DataFrame, n: int = 20) -> DataFrame:
    """Round-robin sample of own-organisation page sections, restamped as structure-verified."""
    own = candidate_rows.where(F.col("own_organisation") & (F.col("record_type") == "page_section"))
    return round_robin(own, "source_id", "service_name", n, "position").withColumns({
        "review_status": F.lit(V.SAMPLE_REVIEW_STATUS),
        "safety_notes": F.lit(V.SAMPLE_SAFETY_NOTE),
    })


