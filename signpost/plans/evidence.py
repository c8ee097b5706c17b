"""Content-level service records and parse samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schemas as S
from signpost import vocabulary as V
from signpost.functions.text import (
    blank, clean_text, digest, is_missing, iso_date, join_or, looks_like_html, media_type,
    non_html_summary, present,
)
from signpost.operators import extract as X
from signpost.operators.pages import parse_pages
from signpost.sources.tables import only_urls, with_fetch_outcome

USEFUL_STATUS = "content_verified_for_proposal"
HASH_FIELDS = tuple(f for f in S.USEFUL_RECORD_FIELDS if f != "content_hash")
STABLE_HASH_FIELDS = tuple(
    f for f in HASH_FIELDS
    if f not in ("source_http_status", "next_step_http_status", "last_verified_date")
)
SAMPLE_SOURCE = ("source_id", "scope_status", "organization", "category", "url")


def useful_records(
    specs: DataFrame,
    fetches: DataFrame,
    pages: DataFrame,
    run_ts: Column,
    organisation: str = "",
    stable_hash: bool = False,
    fragments: Sequence[str] | None = None,
    key: str = "source_url",
) -> DataFrame:
    """A record per spec whose page has meaningful content.

    ``fetches(url, http_status, error)`` and ``pages(url, html)`` hold one row per URL; fetches serve
    both the source pages and the next-step status. Where specs that share a URL have fetches and pages
    of their own, both carry ``service_id`` and ``key`` names it: the spec's own fetch must have succeeded
    and its own page is read, while the status of a URL stays that of every fetch of it. The hash covers status and verification date
    unless ``stable_hash`` is set. Only the excerpts read from a page are joined, never its markup.
    """
    fragments = V.boilerplate_fragments(organisation) if fragments is None else fragments
    keyed = pages.withColumn("source_url", F.col("url"))
    content = (
        parse_pages(only_urls(keyed, specs, key), [key])
        .select(key, "text_pieces", "nodes", F.explode(present(X.first_root_with_paragraphs(fragments))).alias("content"))
        .select(
            key,
            X.leading_paragraphs(F.col("content.paragraphs")).alias("leading"),
            X.access_methods(F.col("content.root")).alias("methods"),
        )
    )
    reached = fetches.where(is_missing("error")).withColumn("source_url", F.col("url")).select(key)
    source_status = fetches.select(
        F.col("url").alias("source_url"), F.col("http_status").alias("source_http_status"))
    status = fetches.select(
        F.col("url").alias("next_step_url"), F.col("http_status").alias("next_step_http_status"))
    found = specs.join(reached, key, "left_semi").join(source_status, "source_url").join(content, key).join(
        status, "next_step_url", "left")
    rows = found.withColumns({
        "service_description": F.substring(F.array_join("leading", " "), 1, 900),
        "source_evidence_excerpt": F.substring(F.get("leading", F.lit(0)), 1, 500),
        "contact_or_access_methods": join_or(F.col("methods"), "next_step_url"),
        "next_step_http_status": F.coalesce("next_step_http_status", F.lit(0)),
        "last_verified_date": iso_date(run_ts),
        "review_status": F.lit(USEFUL_STATUS),
    })
    hashed = STABLE_HASH_FIELDS if stable_hash else HASH_FIELDS
    return rows.withColumn(
        "content_hash", digest(*[F.col(f).cast("string") for f in hashed])
    ).select(*S.USEFUL_RECORD_FIELDS)


def specs_without_content(specs: DataFrame, records: DataFrame) -> DataFrame:
    """Specs that produced no record: no page, no root or no meaningful paragraph."""
    return specs.join(records.select("service_id"), "service_id", "left_anti")


def read_samples(bodies: DataFrame, key: str = "url") -> DataFrame:
    """Sample of each body ``(url, content_type, body, n_bytes)`` by its ``key``; only HTML bodies are parsed."""
    flagged = bodies.withColumn("is_html", looks_like_html("content_type", "body")).withColumn(
        "html", F.when(F.col("is_html"), F.col("body")))
    parsed = parse_pages(flagged, [key, "content_type", "n_bytes", "is_html"])
    other = F.struct(
        F.lit("non_html_metadata").alias("sample_type"),
        non_html_summary(media_type("content_type"), "n_bytes").alias("parsed_sample"))
    return parsed.select(
        key, media_type("content_type").alias("content_type"),
        F.when(F.col("is_html"), X.parse_sample()).otherwise(other).alias("sample"),
        F.when(F.col("is_html"), X.title_tag()).otherwise("").alias("page_title"),
        F.when(F.col("is_html"), X.headings_found()).otherwise(0).alias("headings_found"),
        F.when(F.col("is_html"), X.links_found()).otherwise(0).alias("links_found"),
    )


def url_parse_samples(inventory: DataFrame, fetches: DataFrame, bodies: DataFrame, key: str = "url") -> DataFrame:
    """One parse sample per inventoried URL, a failure row where the fetch failed.

    ``fetches(url, final_url, http_status, retrieved_at, error)`` and
    ``bodies(url, content_type, body, n_bytes)`` hold one row per URL. Where sources that share a URL
    have fetches and bodies of their own, both carry ``source_id`` and ``key`` names it.
    """
    facts = ("content_type", "sample", "page_title", "headings_found", "links_found")
    read = read_samples(only_urls(bodies, inventory, key), key)
    outcome = fetches.select(key, "final_url", "http_status", "retrieved_at", "error")
    listed = inventory.select(*SAMPLE_SOURCE).join(outcome, key, "left")
    ok = F.col("http_status").isNotNull() & is_missing("error")
    rows = with_fetch_outcome(listed, read, facts, key)
    sample = F.when(ok, blank(F.col("sample.parsed_sample"))).otherwise("")

    def fetched(value: Column, default) -> Column:
        return F.when(ok, F.coalesce(value, F.lit(default))).otherwise(F.lit(default))

    return rows.select(
        *SAMPLE_SOURCE,
        fetched(F.col("final_url"), "").alias("final_url"),
        fetched(F.col("http_status"), 0).cast("int").alias("http_status"),
        fetched(F.col("content_type"), "").alias("content_type"),
        fetched(F.col("page_title"), "").alias("page_title"),
        fetched(F.col("sample.sample_type"), "").alias("sample_type"),
        sample.alias("parsed_sample"), F.length(sample).alias("parsed_sample_chars"),
        fetched(F.col("headings_found"), 0).alias("headings_found"),
        fetched(F.col("links_found"), 0).alias("links_found"),
        (sample != "").alias("parseable"), "retrieved_at",
        clean_text(blank("error")).alias("error"),
    )
