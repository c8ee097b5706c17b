"""Counts, missingness, duplicates and violations over documents, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.functions.text import digest, is_missing
from signpost.operators import merging as M
from signpost.operators import quality as Q
from signpost.queries.ordering import LATEST_SQL, latest
from signpost.queries.pages import CANDIDATES_SQL, SAMPLE_SQL, extracted, pages
from signpost.queries.registry import ORACLES, Tables, query
from signpost.session import written

DOCUMENT_FIELDS = ("doc_id", "lang", "source", "quality", "toxic")


def labelled(t: Tables) -> DataFrame:
    """Documents with their review labels; unlabelled documents have none."""
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")


@query("category_counts", """
SELECT 'documents_by_source' AS section, source AS key, count(*) AS value FROM documents GROUP BY source
UNION ALL SELECT 'documents_by_lang', lang, count(*) FROM documents GROUP BY lang
UNION ALL SELECT 'labels_by_quality', CAST(quality AS VARCHAR), count(*) FROM labels GROUP BY quality
UNION ALL SELECT 'events_by_type', event_type, count(*) FROM events GROUP BY event_type""")
def category_counts(t: Tables) -> DataFrame:
    return Q.union_all([
        Q.counts_by(t.documents, "source", "documents_by_source"),
        Q.counts_by(t.documents, "lang", "documents_by_lang"),
        Q.counts_by(t.labels, "quality", "labels_by_quality"),
        Q.counts_by(t.events, "event_type", "events_by_type")])


@query("missingness", "WITH l AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(
    f"SELECT 'missing' AS section, '{f}' AS key, count(CASE WHEN {f} IS NULL OR CAST({f} AS VARCHAR) = '' THEN 1 END) AS value FROM l"
    for f in DOCUMENT_FIELDS))
def missingness(t: Tables) -> DataFrame:
    return Q.missing_values(labelled(t), DOCUMENT_FIELDS, "missing")


@query("distinct_counts", """
SELECT 'events' AS section, 'users' AS key, count(DISTINCT user_id) AS value FROM events
UNION ALL SELECT 'events', 'users_with_errors', count(DISTINCT user_id) FROM events WHERE event_type = 'error'
UNION ALL SELECT 'events', 'types', count(DISTINCT event_type) FROM events
UNION ALL SELECT 'events', 'repeated_users', count(*) - count(DISTINCT user_id) FROM events""")
def distinct_counts(t: Tables) -> DataFrame:
    return Q.single_values(t.events, "events", {
        "users": F.count_distinct("user_id"),
        "users_with_errors": Q.distinct_when(F.col("event_type") == "error", "user_id"),
        "types": F.count_distinct("event_type"),
        "repeated_users": Q.duplicate_count("user_id")})


SECOND_LOAD = "2024-01-16"


@query("distinct_counts_merged", """
SELECT 'users' AS section, event_type AS key, count(DISTINCT user_id) AS value, count(*) AS rows FROM events GROUP BY event_type
UNION ALL SELECT 'props', event_type, count(DISTINCT props), count(*) FROM events GROUP BY event_type""")
def distinct_counts_merged(t: Tables) -> DataFrame:
    """Two loads of the log, each reduced to its bitmaps; the report joins what is stored."""
    loads = [t.events.where(F.col("ts") < SECOND_LOAD), t.events.where(F.col("ts") >= SECOND_LOAD)]
    parts, numbers = [], {"user_id": None, "props": None}
    for load in loads:
        for section, value in (("users", "user_id"), ("props", "props")):
            numbers[value] = M.extended_ids(numbers[value], load, value)
            rows = M.with_ids(load.select(F.lit(section).alias("section"), F.col("event_type").alias("key"), value), numbers[value], value)
            parts.append(written(M.distinct_parts(rows, ["section", "key"], "id"), "bitmaps"))
    return M.distinct_totals(M.merged_parts(*parts), ["section", "key"]).withColumnRenamed("values", "value")


@query("duplicate_ids", """
SELECT 'text_repeated' AS rule, sha256(text) AS key, CAST(count(*) AS VARCHAR) AS detail FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_ids(t: Tables) -> DataFrame:
    rows = t.documents.select(digest("text").alias("record_id"))
    return Q.not_unique(rows, "record_id", "text_repeated")


@query("success_ratio", """
SELECT 'fetches' AS section, 'succeeded' AS key, count(CASE WHEN event_type <> 'error' THEN 1 END) AS value FROM events
UNION ALL SELECT 'fetches', 'total', count(*) FROM events""")
def success_ratio(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 0).otherwise(200)
    return Q.single_values(t.events.select(status.alias("http_status")), "fetches", Q.success_ratio())


@query("sample_lengths", SAMPLE_SQL + """
SELECT round(avg(length(parsed_sample)), 6) AS mean_chars, min(length(parsed_sample)) AS min_chars, max(length(parsed_sample)) AS max_chars
FROM sample WHERE parsed_sample <> ''""")
def sample_lengths(t: Tables) -> DataFrame:
    from signpost.operators.extract import parse_sample
    from signpost.operators.pages import parse_pages

    length = F.length(parse_sample()["parsed_sample"])
    rows = parse_pages(pages(t), ["page_id"]).select(length.cast("bigint").alias("parsed_sample_chars"))
    rows = rows.withColumn("parseable", F.col("parsed_sample_chars") > 0)
    return rows.agg(*Q.sample_lengths()).withColumn("mean_chars", F.round("mean_chars", 6))


@query("records_per_source", CANDIDATES_SQL + """
SELECT 'candidate_source' AS section, CAST(page_id AS VARCHAR) AS key, count(*) AS value FROM items GROUP BY page_id""")
def records_per_source(t: Tables) -> DataFrame:
    """Records per source after the cap and before the global deduplication."""
    rows = extracted(t).select("source_id", F.explode("items").alias("item"))
    return Q.counts_by(rows, "source_id", "candidate_source")


@query("category_mismatch", """
WITH seen AS (SELECT DISTINCT source FROM documents), wanted AS (
  SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION SELECT DISTINCT n_name FROM nation)
SELECT 'source_mismatch' AS rule, COALESCE(s.source, w.source) AS key,
  CASE WHEN s.source IS NULL THEN 'expected only' ELSE 'observed only' END AS detail
FROM seen s FULL JOIN wanted w USING (source) WHERE s.source IS NULL OR w.source IS NULL""")
def category_mismatch(t: Tables) -> DataFrame:
    expected = labelled(t).where("toxic = 1").select("source").union(t.nation.select("n_name"))
    return Q.set_mismatch(t.documents, expected, "source", "source_mismatch")


@query("required_missing", """
SELECT 'label_missing' AS rule, CAST(d.doc_id AS VARCHAR) AS key, 'quality,toxic' AS detail
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL""")
def required_missing(t: Tables) -> DataFrame:
    return Q.required_empty(labelled(t), "doc_id", ["lang", "quality", "toxic"], "label_missing")


@query("violations", f"""
WITH {LATEST_SQL}
SELECT 'text_repeated' AS rule, sha256(text) AS key, CAST(count(*) AS VARCHAR) AS detail FROM documents GROUP BY text HAVING count(*) > 1
UNION ALL SELECT 'label_missing', CAST(d.doc_id AS VARCHAR), 'quality' FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL
UNION ALL SELECT 'source_not_allowed', CAST(doc_id AS VARCHAR), source FROM documents
  WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
UNION ALL SELECT 'wrong_region', CAST(s_suppkey AS VARCHAR), r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA'
UNION ALL SELECT 'fetch_failed', CAST(page_id AS VARCHAR), error FROM latest WHERE error <> ''
UNION ALL SELECT 'url_not_parseable', CAST(page_id AS VARCHAR), COALESCE(nullif(error, ''), 'No parseable content found.') FROM latest WHERE http_status <> 200""")
def violations(t: Tables) -> DataFrame:
    allowed = labelled(t).where("toxic = 1").select("source").distinct()
    placed = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    fetches = latest(t)
    reason = F.coalesce(F.nullif("error", F.lit("")), F.lit("No parseable content found."))
    empty = Q.empty_fields(["source", "quality"])
    return Q.union_all([
        duplicate_rows(t),
        Q.broken_rules(Q.with_listed(labelled(t), "source", allowed), "doc_id", {
            "label_missing": (empty != "", empty), "source_not_allowed": (~F.col("_listed"), F.col("source"))}),
        Q.not_matching(placed, "s_suppkey", F.col("r_name") == "ASIA", "r_name", "wrong_region"),
        Q.broken_rules(fetches, "page_id", {
            "fetch_failed": (~is_missing("error"), F.col("error")),
            "url_not_parseable": (~F.coalesce(F.col("http_status") == 200, F.lit(False)), reason)})])


def duplicate_rows(t: Tables) -> DataFrame:
    return Q.not_unique(t.documents.select(digest("text").alias("record_id")), "record_id", "text_repeated")


@query("navigator_violations", CANDIDATES_SQL + """
SELECT 'source_not_structured' AS rule,
  substr(sha256(concat_ws(chr(31), CAST(i.page_id AS VARCHAR), i.record_type, i.service_name, i.service_url)), 1, 20) AS key,
  CAST(i.page_id AS VARCHAR) AS detail
FROM items i JOIN pages p USING (page_id) WHERE p.url NOT LIKE 'https:%'""")
def navigator_violations(t: Tables) -> DataFrame:
    from signpost.plans import navigator, reports

    structured = t.pages.where(F.startswith("url", F.lit("https:"))).select(F.col("page_id").cast("string").alias("source_id"))
    from signpost.session import written

    return reports.navigator_violations(written(navigator.candidates(extracted(t)), "candidates"), structured)


@query("navigator_metrics", CANDIDATES_SQL + """
, cand AS (SELECT i.*, f.url LIKE 'https:%' AS own FROM items i JOIN fetched f USING (page_id)),
field AS (SELECT unnest(['record_id', 'source_id', 'organization', 'category', 'authority_level', 'own_organisation', 'service_name', 'record_type',
  'section', 'source_page_title', 'source_url', 'service_url', 'retrieved_at', 'requires_human_review', 'review_status', 'content_hash']) AS f, 0 AS n
  UNION ALL SELECT unnest(['student_types', 'eligibility_notes', 'location', 'language', 'delivery_format', 'contact_method',
  'recommended_next_step', 'safety_notes', 'source_last_updated']), (SELECT count(*) FROM cand))
SELECT 'candidates' AS section, 'records' AS key, count(*) AS value FROM cand
UNION ALL SELECT 'candidates', 'own_records', count(CASE WHEN own THEN 1 END) FROM cand
UNION ALL SELECT 'candidates', 'own_sources', count(DISTINCT CASE WHEN own THEN page_id END) FROM cand
UNION ALL SELECT 'candidates', 'duplicate_ids', 0
UNION ALL SELECT 'samples', 'records', least(20, count(*)) FROM cand WHERE own AND record_type = 'page_section'
UNION ALL SELECT 'inventory', 'sources', count(*) FROM pages
UNION ALL SELECT 'inventory', 'approved', count(*) FROM pages
UNION ALL SELECT 'inventory', 'candidates', 0
UNION ALL SELECT 'approved_status', CASE WHEN l.page_id IS NULL THEN 'not_executed' WHEN l.error = '' THEN 'live_extraction_succeeded'
  ELSE 'live_extraction_failed' END, count(*) FROM pages p LEFT JOIN latest l USING (page_id) GROUP BY ALL
UNION ALL SELECT 'fetches', 'succeeded', count(CASE WHEN error = '' THEN 1 END) FROM fetched
UNION ALL SELECT 'fetches', 'total', count(*) FROM fetched
UNION ALL SELECT 'fetches', 'failed', count(CASE WHEN error <> '' THEN 1 END) FROM fetched
UNION ALL SELECT 'candidate_category', 'services', count(*) FROM cand
UNION ALL SELECT 'candidate_source', CAST(page_id AS VARCHAR), count(*) FROM cand GROUP BY page_id
UNION ALL SELECT 'candidate_missing', f, n FROM field""")
def navigator_metrics(t: Tables) -> DataFrame:
    from signpost.plans import navigator, reports
    from signpost.session import written

    source = written(extracted(t), "extracted")  # candidates and manifest both read it
    rows, manifest = written(navigator.candidates(source), "candidates"), navigator.manifest(source)
    registry = t.pages.select(
        F.col("page_id").cast("string").alias("source_id"), "url", F.lit("approved").alias("scope_status"),
        F.lit("structured_html").alias("extraction_method"))
    evidence = t.spark.createDataFrame([], "source_id string, evidence_path string, evidence_exists boolean")
    inventory = navigator.inventory(registry, manifest, evidence)
    return reports.navigator_metrics(rows, navigator.review_samples(rows), inventory, manifest)


@query("rejected_records", """
WITH r AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'https://example.org/' || source WHEN lang = 'fr' THEN '' WHEN lang = 'de' THEN 'ftp://example.org' END AS url,
  CASE WHEN source <> 'src3' THEN source END AS category FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS record_id, concat_ws(', ', CASE WHEN category IS NULL THEN 'missing:category_id' END,
  CASE WHEN url = '' OR url LIKE 'ftp%' THEN 'invalid:official_source_url' END) AS rejected_because
FROM r WHERE category IS NULL OR url = '' OR url LIKE 'ftp%'""")
def rejected_records(t: Tables) -> DataFrame:
    """Documents as directory records: some without a category, some with an empty or foreign URL."""
    from signpost.schemas import SERVICE_RECORDS
    from signpost.sources.files import check_service_records, conform

    lang = F.col("lang")
    url = F.when(lang == "en", F.concat(F.lit("https://example.org/"), "source")).when(lang == "fr", "").when(lang == "de", "ftp://example.org")
    records = t.documents.select(
        F.col("doc_id").cast("string").alias("record_id"), F.col("source").alias("service_name"),
        F.when(F.col("source") != "src3", F.col("source")).alias("category_id"), lang.alias("category_label"), url.alias("official_source_url"))
    checked = check_service_records(conform(records, SERVICE_RECORDS))
    return checked.where(F.col("rejected_because").isNotNull()).select("record_id", "rejected_because")


@query("parse_sample_metrics", f"""
WITH s AS MATERIALIZED (SELECT * FROM ({ORACLES['parse_samples']}) x)
SELECT 'parse_samples' AS section, 'urls' AS key, count(*) AS value FROM s
UNION ALL SELECT 'parse_samples', 'parseable', count(CASE WHEN parseable THEN 1 END) FROM s
UNION ALL SELECT 'parse_samples', 'failed', count(CASE WHEN NOT parseable THEN 1 END) FROM s
UNION ALL SELECT 'parse_samples', 'min_chars', min(length(parsed_sample)) FROM s WHERE parseable
UNION ALL SELECT 'parse_samples', 'max_chars', max(length(parsed_sample)) FROM s WHERE parseable
UNION ALL SELECT 'sample_type', sample_type, count(*) FROM s GROUP BY sample_type""")
def parse_sample_metrics(t: Tables) -> DataFrame:
    from signpost.plans import reports
    from signpost.queries.pages import sample_rows
    from signpost.session import written

    return reports.sample_metrics(written(sample_rows(t), "samples"))


@query("parse_sample_violations", f"""
SELECT 'url_not_parseable' AS rule, source_id AS key, CASE WHEN error = '' THEN 'No parseable content found.' ELSE error END AS detail
FROM ({ORACLES['parse_samples']}) x WHERE NOT parseable""")
def parse_sample_violations(t: Tables) -> DataFrame:
    from signpost.plans import reports
    from signpost.queries.pages import sample_rows

    return reports.sample_violations(sample_rows(t))


@query("useful_metrics", f"""
WITH u AS MATERIALIZED (SELECT * FROM ({ORACLES['useful_records']}) x)
SELECT 'useful' AS section, 'records' AS key, count(*) AS value FROM u
UNION ALL SELECT 'useful', 'categories', least(1, count(*)) FROM u
UNION ALL SELECT 'useful', 'source_ok', count(CASE WHEN source_http_status = 200 THEN 1 END) FROM u
UNION ALL SELECT 'useful', 'next_step_ok', 0
UNION ALL SELECT 'useful_missing', unnest(['service_id', 'service_name', 'category', 'intended_users', 'service_description', 'delivery_context',
  'contact_or_access_methods', 'recommended_next_step', 'next_step_url', 'source_url', 'source_evidence_excerpt', 'source_http_status',
  'next_step_http_status', 'last_verified_date', 'limitation', 'review_status', 'content_hash']), 0""")
def useful_metrics(t: Tables) -> DataFrame:
    from signpost.plans import reports
    from signpost.queries.pages import useful_rows
    from signpost.session import written

    return reports.useful_metrics(written(useful_rows(t), "useful"))


@query("specs_without_content", f"""
SELECT CAST(page_id AS VARCHAR) AS service_id FROM pages
WHERE CAST(page_id AS VARCHAR) NOT IN (SELECT service_id FROM ({ORACLES['useful_records']}) x)""")
def specs_without_content(t: Tables) -> DataFrame:
    from signpost.plans import evidence
    from signpost.queries.pages import service_specs, useful_rows

    return evidence.specs_without_content(service_specs(t), useful_rows(t)).select("service_id")
