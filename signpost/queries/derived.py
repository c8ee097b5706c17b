"""Guidance, partner and facility tables over pages that Spark derives from the benchmark tables.

The benchmark pages have no hub, listing or detail markup, so documents are rendered as guidance
pages and suppliers as partner pages; the SQL states the result from the tables directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schemas as S
from signpost import vocabulary as V
from signpost.functions.text import clean_text, iso_instant
from signpost.plans import facilities as FAC
from signpost.plans import guidance, partners, reports
from signpost.queries.registry import Tables, query
from signpost.sources.files import detail_pages

SITE = "https://www.quebec.ca"


def _escape(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _documents(t: Tables) -> DataFrame:
    text = clean_text("text")
    first = F.get(F.split(text, " ", 2), F.lit(0))
    return t.documents.select(
        "doc_id", "lang", "source", first.alias("word"), F.substr(text, F.length(first) + 2).alias("rest"))


def hub_fetches(t: Tables, failing: bool = False) -> DataFrame:
    """Each document as a hub page; pages of ``src3`` lack the first section.

    With ``failing`` the pages in other languages than English could not be loaded.
    """
    word, rest = _escape(F.col("word")), _escape(F.col("rest"))

    def section(index: int, title: str) -> Column:
        body = F.concat(
            F.lit(f"<div>\n<h2>{title} </h2><h3>"), "lang", F.lit(f" {title}</h3><h4>See also</h4><p><b>"), word,
            F.lit("</b> "), rest if index == 1 else F.lit("more"), F.lit("</p><p>not <b>leading</b></p><a href='/"), "lang",
            F.lit("/"), "source", F.lit("/#top'>"), "source", F.lit("  page</a><a href='"), F.lit("https://www.ramq.gouv.qc.ca/"),
            F.col("doc_id").cast("string"), F.lit("'></a><a href='#self'>self</a><a>none</a></div>"))
        return F.when(F.col("source") == "src3", F.lit("")).otherwise(body) if index == 0 else body

    html = F.concat(
        F.lit("<html><body><h1>Outer</h1><main id='main'><h1>"), "source", F.lit("</h1><p class='dateMiseAJour'>Last update: "),
        "lang", F.lit("</p>"), *[section(i, s) for i, (s, _) in enumerate(V.SECTION_CATEGORIES)], F.lit("</main></body></html>"))
    return _documents(t).select(
        F.concat(F.lit(SITE + "/en/doc/"), F.col("doc_id").cast("string")).alias("url"), F.lit(200).alias("http_status"),
        F.timestamp_seconds("doc_id").alias("retrieved_at"),
        (F.when(F.col("lang") == "en", "").otherwise("offline") if failing else F.lit("")).alias("error"), html.alias("html"))


def detail_fetches(t: Tables) -> DataFrame:
    """Each document as one fetch of the detail page its source stands for."""
    urls = F.array(*[F.lit(u) for u, _ in V.DETAIL_PAGE_CATEGORIES])
    number = F.regexp_extract("source", r"([0-9]+)$", 1).cast("int") % len(V.DETAIL_PAGE_CATEGORIES)
    html = F.concat(
        F.lit("<main><h1>"), "lang", F.lit("</h1><h2>"), _escape(F.col("word")), F.lit("</h2><h3>"), "source",
        F.lit("</h3><h2></h2><p>"), _escape(F.col("rest")), F.lit("</p><a href='/x/"), "source", F.lit("'>"), _escape(F.col("word")), F.lit("</a><a href='"),
        F.lit(V.DETAIL_PAGE_CATEGORIES[1][0]), F.lit("'>listed</a><a href='mailto:a@b'>m</a></main>"))
    return _documents(t).select(
        F.get(urls, number).alias("url"), F.lit(200).alias("http_status"),
        F.timestamp_seconds("doc_id").alias("retrieved_at"), F.lit("").alias("error"), html.alias("html"))


def catalogue(t: Tables) -> DataFrame:
    hub = guidance.hub_records(guidance.read_guidance_pages(hub_fetches(t)))
    return guidance.catalogue(hub, guidance.detail_records(detail_fetches(t), detail_pages(t.spark)))


def _values(rows) -> str:
    def quoted(x):
        return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quoted(x) for x in r) + ")" for r in rows)


_SECTIONS = [(i, s, c) for i, (s, c) in enumerate(V.SECTION_CATEGORIES)]
_DETAIL = [(i, u, c) for i, (u, c) in enumerate(V.DETAIL_PAGE_CATEGORIES)]
CATALOGUE_SQL = rf"""
WITH section AS (SELECT * FROM (VALUES {_values(_SECTIONS)}) v(i, section, category)),
detail AS (SELECT * FROM (VALUES {_values(_DETAIL)}) v(i, url, category)),
doc0 AS (SELECT doc_id, lang, source, trim(regexp_replace(text, '[\s\p{{Z}}\x0B\x1c-\x1f\x{{85}}]+', ' ', 'g')) AS t FROM documents),
doc AS (SELECT *, split_part(t, ' ', 1) AS word, substr(t, length(split_part(t, ' ', 1)) + 2) AS rest FROM doc0),
hub AS (
  SELECT d.*, 'https://www.quebec.ca/en/doc/' || doc_id AS url, sha256(d.source || ' Last update: ' || lang || ' ' || (
    SELECT string_agg(concat_ws(' ', section, lang || ' ' || section, 'See also', nullif(word, ''),
      nullif(CASE WHEN i = 1 THEN rest ELSE 'more' END, ''), 'not leading', d.source || ' page', 'self none'), ' ' ORDER BY i)
    FROM section WHERE NOT (i = 0 AND d.source = 'src3'))) AS content_hash
  FROM doc d),
hub_section AS (SELECT * FROM hub CROSS JOIN section s WHERE NOT (s.i = 0 AND hub.source = 'src3')),
hub_rows AS (
  SELECT doc_id, url, source AS page_title, lang AS updated, content_hash, section, category, 'hub_action' AS record_type,
    lang || ' ' || section AS title, '' AS linked FROM hub_section
  UNION ALL
  SELECT doc_id, url, source, lang, content_hash, section, category, 'hub_action', word, '' FROM hub_section
  WHERE word NOT IN ('', 'On this page:', 'See also', 'Need help?', 'Report a problem', lang || ' ' || section)
  UNION ALL
  SELECT doc_id, url, source, lang, content_hash, section, category, 'linked_resource', source || ' page',
    'https://www.quebec.ca/' || lang || '/' || source FROM hub_section
  UNION ALL
  SELECT doc_id, url, source, lang, content_hash, section, category, 'linked_resource', 'https://www.ramq.gouv.qc.ca/' || doc_id,
    'https://www.ramq.gouv.qc.ca/' || doc_id FROM hub_section),
det AS (
  SELECT d.*, x.url, x.category, sha256(concat_ws(' ', lang, nullif(word, ''), source, nullif(rest, ''), nullif(word, ''), 'listed m')) AS content_hash
  FROM doc d JOIN detail x ON x.i = CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % {len(_DETAIL)}),
detail_rows AS (
  SELECT doc_id, url, lang AS page_title, '' AS updated, content_hash, lang AS section, category, 'detail_action' AS record_type,
    word AS title, '' AS linked FROM det WHERE word <> ''
  UNION ALL
  SELECT doc_id, url, lang, '', content_hash, lang, category, 'detail_action', source, '' FROM det WHERE source <> word
  UNION ALL
  SELECT doc_id, url, lang, '', content_hash, lang, category, 'linked_resource',
    CASE WHEN word = '' THEN 'https://www.quebec.ca/x/' || source ELSE word END, 'https://www.quebec.ca/x/' || source FROM det),
built AS (
  SELECT *, substr(sha256(concat_ws(chr(31), category, record_type, url, title, linked)), 1, 20) AS record_id,
    CASE WHEN linked = '' THEN '' ELSE title END AS linked_title, 0 AS source_rank FROM hub_rows
  UNION ALL
  SELECT *, substr(sha256(concat_ws(chr(31), category, record_type, url, title, linked)), 1, 20),
    CASE WHEN linked = '' THEN '' ELSE title END, 1 FROM detail_rows),
catalogue AS (
  SELECT record_id, category, record_type, title AS action_title, section, page_title AS source_page_title, url AS source_page_url,
    linked_title AS linked_resource_title, linked AS linked_resource_url,
    CASE WHEN linked LIKE 'https://www.ramq%' THEN 'Régie de l''assurance maladie du Québec' ELSE 'Gouvernement du Québec' END AS linked_resource_agency,
    linked = '' AS deep_parsed, updated AS source_last_updated,
    strftime(make_timestamp(doc_id * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS retrieved_at, TRUE AS requires_human_review,
    content_hash AS source_content_hash,
    sha256(concat_ws(chr(31), category, record_type, title, section, url, linked_title, linked, content_hash)) AS record_content_hash
  FROM built QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY source_rank DESC, url DESC, doc_id DESC) = 1)"""


@query("guidance_catalogue", CATALOGUE_SQL + """
SELECT * FROM catalogue""")
def guidance_catalogue(t: Tables) -> DataFrame:
    return catalogue(t).withColumn("retrieved_at", iso_instant("retrieved_at")).select(*S.GUIDANCE_FIELDS)


@query("review_queue", CATALOGUE_SQL + """
SELECT record_id, category, action_title, source_page_url, linked_resource_url, '' AS eligibility, '' AS delivery_format,
  '' AS plain_language_summary, '' AS safety_notes, '' AS reviewer, 'pending' AS approval_status, '' AS reviewed_at FROM catalogue""")
def review_queue(t: Tables) -> DataFrame:
    return guidance.review_queue(catalogue(t))


@query("missing_sections", """
SELECT 'https://www.quebec.ca/en/doc/' || doc_id AS url, 'Housing' AS section FROM documents WHERE source = 'src3'""")
def missing_sections(t: Tables) -> DataFrame:
    return guidance.missing_sections(guidance.read_guidance_pages(hub_fetches(t)))


@query("source_manifest", CATALOGUE_SQL + """
SELECT substr(sha256(concat_ws(chr(31), 'quebec_guidance', url)), 1, 20) AS source_id, 'quebec_guidance' AS source_type, url,
  CASE WHEN lang = 'en' THEN source ELSE '' END AS title, CASE WHEN lang = 'en' THEN 200 ELSE 0 END AS http_status,
  CASE WHEN lang = 'en' THEN lang ELSE '' END AS source_last_updated,
  CASE WHEN lang = 'en' THEN content_hash ELSE '' END AS content_hash, TRUE AS deep_parsed,
  CASE WHEN lang = 'en' THEN '' ELSE 'offline' END AS error FROM hub
UNION ALL
SELECT substr(sha256(concat_ws(chr(31), 'archive', 'https://example.org/' || doc_id)), 1, 20), 'archive', 'https://example.org/' || doc_id,
  'Archive', 200, '', sha256(lower(hex(encode(text)))), TRUE, '' FROM documents""")
def source_manifest(t: Tables) -> DataFrame:
    """Hub pages (other languages than English failed to load) and each document as a binary archive."""
    archives = t.documents.select(
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"), F.lit(200).alias("http_status"),
        F.timestamp_seconds("doc_id").alias("retrieved_at"), F.encode("text", "UTF-8").alias("content"), F.lit("").alias("error"))
    pages = guidance.page_manifest(guidance.read_guidance_pages(hub_fetches(t, failing=True)))
    return pages.unionByName(guidance.archive_manifest(archives, "archive", "Archive")).drop("retrieved_at")


# -- partners --------------------------------------------------------------------------------


def partner_pages(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Suppliers as partner cards, eight listing pages per list, one card per page.

    A supplier in debt has an empty page. Detail pages of the first nation are missing.
    """
    key = F.col("s_suppkey").cast("string")
    card = F.concat(
        F.lit("<div class='partner-element x'><h3 class='partner-name'><a href='/en/partner/"), key, F.lit("'>"), "s_name",
        F.lit(" <b>&amp;</b> Co</a></h3><p>Address</p><p>"), key, F.lit("<br>Main St</p><a href='https://maps.example.org/"), key,
        F.lit("'>View <i>map</i></a><a href='https://listed.example.org/"), key,
        F.lit("'>Website</a><span class='langs'>French,\n English</span></div>"))
    listing = t.supplier.select(
        F.floor(F.col("s_suppkey") / 8).alias("list_id"), (F.col("s_suppkey") % 8 + 1).cast("int").alias("page_no"),
        F.when(F.col("s_acctbal") < 0, "<p>nothing</p>").otherwise(card).alias("html"))
    nation = F.col("s_nationkey").cast("string")
    detail = F.concat(
        F.lit("<div><h2>Offered service(s)</h2><ul><li>Help "), nation, F.lit("</li><li>Advice</li></ul></div>"),
        F.lit("<ul><li><span class='prop-title'>Municipality</span> Old</li><li><span class='prop-title'>Municipality</span> Town "), nation,
        F.lit("</li><li><span class='prop-title'>Daycare center</span></li></ul><div class='coordonnees-section'>"),
        F.when(F.col("s_nationkey") < 12, F.concat(F.lit("<a href='https://map.example.org'>m</a><a href='https://own.example.org/"), key, F.lit("'>w</a>")))
        .otherwise(""), F.lit("<a href='tel:"), key, F.lit("'>514 <b>"), key, F.lit("</b></a><a href='mailto:"), key,
        F.lit("@example.org'>mail</a><div class='date-section'>9<br>17</div></div><p class='dateMiseAJour'>Last update: May "), nation, F.lit("</p>"))
    details = t.supplier.where(F.col("s_nationkey") > 0).select(
        F.concat(F.lit(SITE + "/en/partner/"), key).alias("url"), detail.alias("html"))
    return listing, details


@query("partner_directory", """
WITH p AS (SELECT *, s_suppkey // 8 AS list_id, s_suppkey % 8 + 1 AS page_no FROM supplier),
stop AS (SELECT list_id, min(CASE WHEN s_acctbal < 0 THEN page_no END) AS stop_at FROM p GROUP BY 1),
kept AS (SELECT p.*, s_nationkey > 0 AS has_detail FROM p JOIN stop USING (list_id) WHERE stop_at IS NULL OR page_no < stop_at)
SELECT s_name || ' & Co' AS name, 'https://www.quebec.ca/en/partner/' || s_suppkey AS detail_url, s_suppkey || ' Main St' AS listing_address,
  'French, English' AS listing_languages, 'https://maps.example.org/' || s_suppkey AS map_url,
  'https://listed.example.org/' || s_suppkey AS listing_website,
  CASE WHEN has_detail THEN 'Help ' || s_nationkey || ' | Advice' ELSE '' END AS services,
  '' AS regular_staff_languages, '' AS casual_volunteer_languages, '' AS reduced_mobility_access, '' AS daycare,
  CASE WHEN has_detail THEN '9 17' ELSE '' END AS contact_hours, CASE WHEN has_detail THEN '514 ' || s_suppkey ELSE '' END AS phone,
  CASE WHEN has_detail THEN s_suppkey || '@example.org' ELSE '' END AS email,
  CASE WHEN has_detail AND s_nationkey < 12 THEN 'https://own.example.org/' || s_suppkey ELSE 'https://listed.example.org/' || s_suppkey END AS website,
  s_suppkey || ' Main St' AS address, '' AS holiday_period, '' AS territory_covered, '' AS administrative_region,
  CASE WHEN has_detail THEN 'Town ' || s_nationkey ELSE '' END AS municipality,
  CASE WHEN has_detail THEN 'May ' || s_nationkey ELSE '' END AS source_last_updated
FROM kept""")
def partner_directory(t: Tables) -> DataFrame:
    from signpost.sinks.files import interchange

    listing, details = partner_pages(t)
    rows = partners.directory(partners.listing(listing, 8), partners.details(details))
    return interchange(rows, S.PARTNER_FIELDS, strict=True)


# -- facilities ------------------------------------------------------------------------------


def facility_source(t: Tables) -> DataFrame:
    """Suppliers as rows of the facility source file."""
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    key, empty = F.col("s_suppkey").cast("string"), F.lit("")
    coordinate = F.when(F.col("s_acctbal") < 0, "").otherwise(F.concat(F.lit("45."), key))
    return joined.select(
        key.alias("index"), F.concat(F.lit("  "), "s_name", F.lit("\t Clinic ")).alias("facility_name"),
        F.col("r_name").alias("source_facility_type"), F.lower("r_name").alias("odhf_facility_type"), F.lit("p q").alias("provider"),
        empty.alias("unit"), key.alias("street_no"), F.lit("Main").alias("street_name"), empty.alias("postal_code"),
        F.col("n_name").alias("city"), F.when(F.col("r_name") == "AMERICA", "QC").otherwise("on").alias("province"),
        empty.alias("source_format_str_address"), F.col("n_name").alias("CSDname"),
        F.concat(F.col("n_nationkey").cast("string"), F.lit(".0")).alias("CSDuid"), F.col("n_regionkey").cast("string").alias("Pruid"),
        coordinate.alias("latitude"), coordinate.alias("longitude"))


CITY = "6.0"


@query("facilities", """
WITH f AS (
  SELECT 'odhf-' || s_suppkey AS facility_id, s_name || ' Clinic' AS facility_name, r_name AS source_facility_type,
    lower(r_name) AS normalized_facility_type, 'p q' AS provider, '' AS unit, CAST(s_suppkey AS VARCHAR) AS street_no, 'Main' AS street_name,
    '' AS postal_code, n_name AS city, CASE WHEN r_name = 'AMERICA' THEN 'QC' ELSE 'on' END AS province, '' AS source_formatted_address,
    n_name AS csd_name, n_nationkey || '.0' AS csd_uid, CAST(n_regionkey AS VARCHAR) AS province_uid,
    CASE WHEN s_acctbal < 0 THEN '' ELSE '45.' || s_suppkey END AS latitude, CASE WHEN s_acctbal < 0 THEN '' ELSE '45.' || s_suppkey END AS longitude,
    'https://www150.statcan.gc.ca/n1/en/pub/13-26-0001/2020001/ODHF_v1.1.zip' AS source_url
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 6)
SELECT *, sha256(concat_ws(chr(31), facility_id, facility_name, source_facility_type, normalized_facility_type, provider, unit, street_no,
  street_name, postal_code, city, province, source_formatted_address, csd_name, csd_uid, province_uid, latitude, longitude, source_url))
  AS record_content_hash FROM f""")
def facilities(t: Tables) -> DataFrame:
    rows = FAC.facilities(facility_source(t), F.to_timestamp(F.lit("2026-06-12 00:00:00")), geography_code=CITY)
    return rows.drop("retrieved_at").orderBy(*FAC.facility_order())


@query("facility_counts", """
SELECT count(*) AS country_rows, count(CASE WHEN r_name = 'AMERICA' THEN 1 END) AS province_rows,
  count(CASE WHEN n_nationkey = 6 THEN 1 END) AS city_rows
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def facility_counts(t: Tables) -> DataFrame:
    return FAC.nested_counts(facility_source(t), CITY)


# -- reports ---------------------------------------------------------------------------------

_REPORT_SQL = CATALOGUE_SQL + """,
facility AS (
  SELECT s_suppkey, lower(r_name) AS kind, s_acctbal < 0 AS unplaced FROM supplier
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 6)"""


def _missing_sql(section: str, source: str, fields) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{section}' AS section, '{f}' AS key, count(CASE WHEN COALESCE(CAST({f} AS VARCHAR), '') = '' THEN 1 END) AS value FROM {source}"
        for f in fields)


_FACILITY_MISSING = {"unit": "count(*)", "postal_code": "count(*)", "source_formatted_address": "count(*)",
                     "latitude": "count(CASE WHEN unplaced THEN 1 END)", "longitude": "count(CASE WHEN unplaced THEN 1 END)"}


@query("guidance_metrics", _REPORT_SQL + f"""
SELECT 'guidance' AS section, 'records' AS key, count(*) AS value FROM catalogue
UNION ALL SELECT 'guidance', 'source_pages', count(DISTINCT source_page_url) FROM catalogue
UNION ALL SELECT 'guidance', 'deep_source_pages', count(DISTINCT source_page_url) FROM catalogue WHERE deep_parsed
UNION ALL SELECT 'guidance', 'linked_resources', count(DISTINCT linked_resource_url) FROM catalogue WHERE linked_resource_url <> ''
UNION ALL SELECT 'guidance', 'duplicate_ids', count(*) - count(DISTINCT record_id) FROM catalogue
UNION ALL SELECT 'guidance_category', category, count(*) FROM catalogue GROUP BY category
UNION ALL SELECT 'review_queue', 'records', count(*) FROM catalogue
UNION ALL SELECT 'facilities', 'records', count(*) FROM facility
UNION ALL SELECT 'facilities', 'without_coordinates', count(CASE WHEN unplaced THEN 1 END) FROM facility
UNION ALL SELECT 'facilities', 'duplicate_ids', 0
UNION ALL SELECT 'facility_type', kind, count(*) FROM facility GROUP BY kind
UNION ALL {_missing_sql('guidance_missing', 'catalogue', S.GUIDANCE_FIELDS)}
UNION ALL """ + "\nUNION ALL ".join(
    f"SELECT 'facility_missing', '{f}', {_FACILITY_MISSING.get(f, '0')} FROM facility" if f in _FACILITY_MISSING
    else f"SELECT 'facility_missing', '{f}', 0" for f in S.FACILITY_FIELDS))
def guidance_metrics(t: Tables) -> DataFrame:
    from signpost.session import written

    rows = written(catalogue(t), "catalogue")  # every section reads it
    sites = written(FAC.facilities(facility_source(t), F.to_timestamp(F.lit("2026-06-12 00:00:00")), geography_code=CITY), "facilities")
    return reports.guidance_metrics(rows, guidance.review_queue(rows), sites)


@query("guidance_violations", _REPORT_SQL + """
SELECT 'guidance_category_mismatch' AS rule, c AS key, 'expected only' AS detail FROM (VALUES ('tenancy')) v(c)
UNION ALL SELECT 'page_not_allowlisted', record_id, source_page_url FROM catalogue WHERE deep_parsed AND source_page_url LIKE '%/doc/%'
UNION ALL SELECT 'facility_outside_city', 'odhf-' || s_suppkey, s_nationkey || '.0' FROM supplier WHERE s_nationkey <> 6
UNION ALL SELECT 'coordinates_missing', 'odhf-' || s_suppkey, '' FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'fetch_failed', 'https://www.quebec.ca/en/doc/' || doc_id, 'offline' FROM documents WHERE lang <> 'en'""")
def guidance_violations(t: Tables) -> DataFrame:
    from signpost.session import written

    rows = written(catalogue(t), "catalogue")
    source = facility_source(t)
    every = written(source.select(
        F.concat(F.lit("odhf-"), "index").alias("facility_id"), F.col("CSDuid").alias("csd_uid"), "latitude", "longitude"), "every")
    manifest = t.documents.select(
        F.concat(F.lit(SITE + "/en/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("lang") == "en", "").otherwise("offline").alias("error"))
    return reports.guidance_violations(
        rows, every, manifest, CITY, (*V.SECTION_CATEGORIES, ("Tenancy", "tenancy")))
