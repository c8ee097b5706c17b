"""Text, hash and URL queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.functions import text as X
from signpost.functions import urls as U
from signpost.plans.guidance import agency_for_url
from signpost.queries.registry import Tables, query
from signpost.sources.tables import decoded


@query("record_ids", r"""
SELECT doc_id, substr(sha256(concat_ws(chr(31), source, lang, text)), 1, 20) AS record_id,
  sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR))) AS record_hash,
  sha256(lower(hex(encode(text)))) AS payload_hash
FROM documents""")
def record_ids(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", X.short_id("source", "lang", "text").alias("record_id"),
        X.digest(F.col("doc_id").cast("string"), "source", "lang", F.col("n_chars").cast("string")).alias("record_hash"),
        X.payload_hash(F.encode("text", "UTF-8")).alias("payload_hash"))


@query("clean_text", r"""
SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}\x0B\x1c-\x1f\x{85}]+', ' ', 'g')) AS cleaned FROM documents""")
def clean_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean_text("text").alias("cleaned"))


@query("casefold_text", r"""SELECT doc_id, replace(lower(text), 'ß', 'ss') AS folded FROM documents""")
def casefold_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.casefold("text").alias("folded"))


@query("text_measures", r"""
WITH c AS (SELECT *, rtrim(trim(regexp_replace(text, '[\s\p{Z}\x0B\x1c-\x1f\x{85}]+', ' ', 'g')), '.:') AS t FROM documents)
SELECT doc_id, substr(t, 1, 600) AS excerpt, length(t) BETWEEN 55 AND 900 AS paragraph_sized,
  contains(replace(lower(t), 'ß', 'ss'), 'tion') OR contains(replace(lower(t), 'ß', 'ss'), 'schlie') AS has_fragment,
  starts_with(t, 'The') OR starts_with(t, 'Le') AS has_prefix,
  CASE WHEN starts_with(t, 'The ') THEN substr(t, 5) ELSE t END AS without_prefix,
  CASE WHEN contains(lang || ';q=1', 'en') OR starts_with(ltrim(text), '<') THEN 'html' ELSE
    'Downloaded non-HTML content with type ' || lang || ' and ' || format('{:,}', n_chars) || ' bytes.' END AS summary
FROM c""")
def text_measures(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("t", X.strip_trailing(X.clean_text("text"), ".:"))
    kind = F.concat(F.col("lang"), F.lit(";q=1"))
    return docs.select(
        "doc_id", X.truncate("t", 600).alias("excerpt"),
        X.length_between("t", 55, 900).alias("paragraph_sized"),
        X.contains_any(X.casefold("t"), ["tion", "schlie"]).alias("has_fragment"),
        X.starts_with_any(F.col("t"), ["The", "Le"]).alias("has_prefix"),
        X.remove_prefix("t", "The ").alias("without_prefix"),
        F.when(F.contains(kind, F.lit("en")) | F.startswith(X.strip("text"), F.lit("<")), "html")
        .otherwise(X.non_html_summary(X.media_type(kind), "n_chars")).alias("summary"))


@query("canonical_urls", r"""
WITH u AS (
  SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin,
    regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
    split_part(split_part(url, '#', 1), '?', 1) AS bare FROM pages)
SELECT page_id, rtrim(split_part(url, '#', 1), '/') AS canonical,
  rtrim(origin || regexp_replace(path, '[^/]*$', '') || 'help', '/') AS relative,
  rtrim(origin || '/a/c', '/') AS rooted,
  rtrim(bare || '?page=9', '/') AS query_only,
  rtrim(split_part(url, ':', 1) || '://other.example.org/x', '/') AS other_host,
  rtrim(origin || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]*/$', ''), '/') AS parent,
  'mailto:help@example.org' AS mail
FROM u""")
def canonical_urls(t: Tables) -> DataFrame:
    def to(href: str, name: str):
        return U.canonical_url("url", F.lit(href)).alias(name)

    return t.pages.select(
        "page_id", to("", "canonical"), to("help#part", "relative"), to("/a/./b/../c/", "rooted"),
        to("?page=9", "query_only"), to("//other.example.org/x", "other_host"), to("..", "parent"),
        to("mailto:help@example.org", "mail"))


@query("page_hosts", r"""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^www\.', '') AS host,
  regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^www\.', '') AS agency,
  CASE WHEN url LIKE 'https:%' THEN 'Gouvernement du Québec' ELSE 'CNESST' END AS listed_agency,
  TRUE AS well_formed, FALSE AS empty_is_valid FROM pages""")
def page_hosts(t: Tables) -> DataFrame:
    listed = F.when(F.startswith("url", F.lit("https:")), "https://WWW.quebec.ca/x").otherwise("http://cnesst.gouv.qc.ca?a=/b")
    return t.pages.select(
        "page_id", U.url_host("url").alias("host"), agency_for_url(F.col("url")).alias("agency"),
        agency_for_url(listed).alias("listed_agency"), U.is_http_url("url").alias("well_formed"),
        U.is_http_url(F.lit("")).alias("empty_is_valid"))


def _as_bytes(text: str) -> Column:
    """Text as Windows-1252 bytes; characters that this set lacks or places elsewhere become question marks."""
    return F.encode(F.regexp_replace(text, r"[^\x00-\x7F\xA0-\xFF]", "?"), "ISO-8859-1")


@query("undeclared_charsets", r"""
SELECT doc_id, ltrim(regexp_replace(text, '[^\x00-\x7F\x{A0}-\x{FF}]', '?', 'g'), chr(65279)) AS html FROM documents""")
def undeclared_charsets(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", _as_bytes("text").alias("content"), F.lit(None).cast("string").alias("content_type"))
    return decoded(rows).select("doc_id", "html")


@query("undeclared_page_charsets", r"""
SELECT page_id, regexp_replace(regexp_replace(html, 'charset', 'chars', 'gi'), '[^\x00-\x7F\x{A0}-\x{FF}]', '?', 'g') AS html FROM pages""")
def undeclared_page_charsets(t: Tables) -> DataFrame:
    unstated = t.pages.withColumn("bare", F.regexp_replace("html", "(?i)charset", "chars"))
    rows = unstated.select("page_id", _as_bytes("bare").alias("content"), F.lit("text/html").alias("content_type"))
    return decoded(rows).select("page_id", "html")
