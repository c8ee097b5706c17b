"""Tables of a data folder, read with the columns that are asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signpost.functions.charsets import STATED, guessed, in_code_page
from signpost.functions.text import blank, fix_windows_1252, is_missing, or_else


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def only_urls(pages: DataFrame, wanted: DataFrame, key: str = "url") -> DataFrame:
    """Pages whose ``url`` (or other ``key``) is wanted, ahead of parsing.

    The optimizer sends a short list to the pages; with a long one both sides shuffle on the key.
    """
    return pages.join(wanted.select(key).distinct(), key, "left_semi")


def decoded(pages: DataFrame, content: str = "content", content_type: str = "content_type", html: str = "html") -> DataFrame:
    """Pages fetched as bytes, with their markup as text in ``html``, for ``parse_pages``.

    The character set is that of the content type, else of the markup's first kilobyte; where neither
    states one, it is guessed from the bytes (``charsets.guessed``). Stated single-byte sets are read as
    browsers do (the Western ones as Windows-1252); everything else is read as UTF-8 with a
    replacement character for every malformed byte.
    """
    name = r"(?i)charset\s*=\s*[\"']?\s*([-\w]+)"
    head = F.decode(F.substring(F.col(content), 1, 1024), "ISO-8859-1")
    stated = F.lower(or_else(F.regexp_extract(blank(content_type), name, 1), F.regexp_extract(head, name, 1)))
    latin = F.decode(content, "ISO-8859-1")
    text = F.when(stated == "", guessed(F.col(content)))
    for page, names in STATED.items():
        text = text.when(stated.isin(*names), fix_windows_1252(latin) if page == "cp1252" else in_code_page(latin, page))
    text = text.otherwise(F.make_valid_utf8(F.col(content).cast("string")))
    return pages.withColumn(html, F.ltrim(text, F.lit("\ufeff")))


def with_fetch_outcome(
    fetch_log: DataFrame, extracted: DataFrame, page_columns: Sequence[str], key: str = "url"
) -> DataFrame:
    """One row per fetch with what was read from its page, null where the fetch failed.

    ``fetch_log(url, error, …)`` is the outer side, so a failed fetch keeps its row. The page side is
    the small result of reading, never the markup. ``key`` names the column that fetches and pages share.
    """
    joined = fetch_log.join(extracted.select(key, *page_columns), key, "left")
    return joined.withColumns({c: F.when(is_missing("error"), F.col(c)) for c in page_columns})


def listing_until_empty(pages: DataFrame, limit: int | None = None, keys=("list_id",)) -> DataFrame:
    """Cards of a paged listing up to the first page without cards, and up to page ``limit`` if given.

    ``pages(*keys, page_no, cards)`` holds the card array of every fetched page. The first empty page
    of a listing is a minimum taken before the shuffle.
    """
    asked = pages if limit is None else pages.where(F.col("page_no") <= limit)
    empty = asked.where(F.coalesce(F.size("cards"), F.lit(0)) == 0)
    stop = empty.groupBy(*keys).agg(F.min("page_no").alias("_stop"))
    return (
        asked.join(stop, list(keys), "left")
        .where(F.col("_stop").isNull() | (F.col("page_no") < F.col("_stop")))
        .select(*keys, "page_no", F.posexplode("cards").alias("card_no", "card"))
        .select(*keys, "page_no", "card_no", "card.*")
    )
