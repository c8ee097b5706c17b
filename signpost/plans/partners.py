"""Partner directory from paged listings and their detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schemas as S
from signpost import vocabulary as V
from signpost.functions.text import blank, casefold
from signpost.operators import extract as X
from signpost.operators.pages import first, parse_pages, with_class
from signpost.sources.tables import listing_until_empty


def partner_order() -> list[Column]:
    return [casefold("name"), casefold("address")]


def listing(list_pages: DataFrame, pages: int = V.PARTNER_LIST_PAGES, site: str = V.PARTNER_SITE_URL) -> DataFrame:
    """Listing rows of ``list_pages(list_id, page_no, html)`` up to the first page without cards."""
    wanted = list_pages.where(F.col("page_no") <= pages)
    parsed = parse_pages(wanted, ["list_id", "page_no"], base=F.lit(site), raw_text=True)
    cards = parsed.select("list_id", "page_no", X.listing_cards().alias("cards"))
    return listing_until_empty(cards, pages)


def details(detail_pages: DataFrame) -> DataFrame:
    """Detail columns per page of ``detail_pages(url, html)``."""
    parsed = parse_pages(detail_pages, ["url"], raw_text=True)
    ready = parsed.withColumns({
        "properties": X.property_entries(),
        "contact": first(with_class("coordonnees-section")),
    })
    return ready.select(
        F.col("url").alias("detail_url"),
        *[value.alias(name) for name, value in X.partner_detail_fields().items()],
    )


def directory(listing_rows: DataFrame, detail_rows: DataFrame) -> DataFrame:
    """Every listed partner with its detail columns; the listing fills website and address.

    ``detail_rows`` holds one row per ``detail_url``.
    """
    joined = listing_rows.join(detail_rows, "detail_url", "left").withColumns({
        "website": F.coalesce("contact_website", "listing_website"),
        "address": F.coalesce("contact_address", "listing_address"),
        "services": F.coalesce("services", F.array().cast("array<string>")),
    })
    text = [f for f in S.PARTNER_FIELDS if f != "services"]
    return joined.withColumns({f: blank(f) for f in text}).select(*S.PARTNER_FIELDS)
