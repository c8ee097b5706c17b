"""Tables in their presentation order: each row's place in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.operators.ordering import with_position
from signpost.plans import guidance, navigator, partners
from signpost.queries.derived import catalogue, partner_directory, review_queue, source_manifest
from signpost.queries.pages import extracted
from signpost.queries.registry import ORACLES, Tables, query


def _folded(column: str) -> str:
    return f"replace(lower({column}), 'ß', 'ss') COLLATE C"


def _places(of: str, columns: str, order: str) -> str:
    return f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS position FROM ({ORACLES[of]}) rows"


@query("catalogue_order", _places("guidance_catalogue", "record_id", f"category, record_type, {_folded('action_title')}, record_id"))
def catalogue_order(t: Tables) -> DataFrame:
    rows = catalogue(t).select("category", "record_type", "action_title", "record_id")
    return with_position(rows, guidance.catalogue_order()).select("record_id", "position")


@query("review_order", _places("review_queue", "record_id", f"category, {_folded('action_title')}, record_id"))
def review_order(t: Tables) -> DataFrame:
    rows = review_queue.build(t).select("category", "action_title", "record_id")
    return with_position(rows, guidance.review_order()).select("record_id", "position")


@query("manifest_order", _places("source_manifest", "source_type, url", "source_type, url"))
def manifest_order(t: Tables) -> DataFrame:
    rows = source_manifest.build(t).select("source_type", "url")
    return with_position(rows, guidance.manifest_order()).select("source_type", "url", "position")


@query("candidate_order", _places("page_candidates", "record_id", f"NOT own_organisation, source_id, {_folded('service_name')}, record_id"))
def candidate_order(t: Tables) -> DataFrame:
    rows = navigator.candidates(extracted(t)).select("own_organisation", "source_id", "service_name", "record_id")
    return with_position(rows, [*navigator.candidate_order(), F.col("record_id")]).select("record_id", "position")


@query("partner_order", _places("partner_directory", "detail_url", f"{_folded('name')}, {_folded('address')}, detail_url"))
def partner_order(t: Tables) -> DataFrame:
    rows = partner_directory.build(t).select("name", "address", "detail_url")
    return with_position(rows, [*partners.partner_order(), F.col("detail_url")]).select("detail_url", "position")
