"""Queries over the page table; each page is its own source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.functions.text import casefold, iso_instant
from signpost.operators import extract as X
from signpost.operators.ordering import carry_forward, first_per_key, ordered_list
from signpost.operators.pages import (
    node_table, parse_pages, tagged, with_page_facts,
)
from signpost.plans import evidence, navigator
from signpost.queries.markup_sql import NODES
from signpost.queries.ordering import LATEST_SQL, latest
from signpost.queries.registry import Tables, query


def pages(t: Tables) -> DataFrame:
    return t.pages


@query("page_nodes", NODES + """
SELECT page_id, seq, end_seq, parent_seq, tag, href, sha256(node_text) AS text_hash FROM nodes""")
def page_nodes(t: Tables) -> DataFrame:
    return node_table(parse_pages(pages(t), ["page_id"]), ["page_id"]).select(
        "page_id", "seq", "end_seq", "parent_seq", "tag", "href", F.sha2("node_text", 256).alias("text_hash"))


@query("page_titles", NODES + """
SELECT page_id, page_title, content_hash, '' AS source_last_updated, b.seq AS root_seq
FROM facts LEFT JOIN body b USING (page_id)""")
def page_titles(t: Tables) -> DataFrame:
    return with_page_facts(parse_pages(pages(t), ["page_id"])).select(
        "page_id", "page_title", "content_hash", "source_last_updated", F.col("root.seq").alias("root_seq"))


@query("page_text", NODES + """SELECT page_id, whole FROM page_text""")
def page_text(t: Tables) -> DataFrame:
    return parse_pages(pages(t), ["page_id"]).select("page_id", F.col("text").alias("whole"))


@query("structural_counts", NODES + """
SELECT page_id, CAST(count(CASE WHEN tag IN ('h1', 'h2', 'h3') THEN 1 END) AS INTEGER) AS headings,
  CAST(count(CASE WHEN tag = 'a' AND href IS NOT NULL THEN 1 END) AS INTEGER) AS links, CAST(count(*) AS INTEGER) AS elements
FROM nodes GROUP BY page_id""")
def structural_counts(t: Tables) -> DataFrame:
    return parse_pages(pages(t), ["page_id"]).select(
        "page_id", X.headings_found().alias("headings"), X.links_found().alias("links"), F.size("nodes").alias("elements"))


@query("ordered_lists", NODES + """
SELECT page_id, string_agg(node_text, ' | ' ORDER BY seq) AS list_items, count(*) AS n_items FROM nodes WHERE tag = 'li' GROUP BY page_id""")
def ordered_lists(t: Tables) -> DataFrame:
    """List items of each page in document order (a group is one page)."""
    rows = node_table(parse_pages(pages(t), ["page_id"]), ["page_id"], tagged("li"))
    return rows.groupBy("page_id").agg(
        F.array_join(ordered_list(F.col("node_text"), F.col("seq")), " | ").alias("list_items"), F.count("*").alias("n_items"))


@query("page_links", NODES + r"""
, l AS (
  SELECT n.page_id, n.seq, rtrim(n.node_text, ':') AS title,
    rtrim(regexp_extract(f.url, '^(https?://[^/?#]*)', 1) || split_part(n.href, '#', 1), '/') AS link_url
  FROM inside n JOIN facts f USING (page_id) WHERE n.tag = 'a' AND n.href IS NOT NULL)
SELECT page_id, link_url, arg_min(trim(title), seq) AS title FROM l WHERE length(title) BETWEEN 4 AND 160
GROUP BY page_id, link_url""")
def page_links(t: Tables) -> DataFrame:
    from signpost import vocabulary as V

    facts = with_page_facts(parse_pages(pages(t), ["page_id", "url"]))
    links = X.internal_links(F.col("root"), F.col("url"), V.skip_titles())
    rows = facts.select("page_id", F.posexplode(links).alias("position", "link")).select(
        "page_id", "position", F.col("link.url").alias("link_url"), F.trim("link.title").alias("title"))
    return first_per_key(rows, ["page_id", "link_url"], ["position"]).drop("position")


@query("carry_forward", NODES + """
, marked AS (SELECT page_id, seq, tag, node_text FROM inside WHERE tag IN ('h1', 'li', 'p', 'b'))
SELECT page_id, seq, sha256(COALESCE(last_value(CASE WHEN tag IN ('h1', 'b') THEN node_text END IGNORE NULLS)
  OVER (PARTITION BY page_id ORDER BY seq ROWS UNBOUNDED PRECEDING), page_title)) AS section
FROM marked JOIN facts USING (page_id)""")
def carry_forward_sections(t: Tables) -> DataFrame:
    facts = with_page_facts(parse_pages(pages(t), ["page_id"]))
    inside = F.col("seq").between(F.col("root.seq") + 1, F.col("root.end_seq"))
    rows = node_table(facts, ["page_id", "page_title", "root"], tagged("h1", "li", "p", "b")).where(inside).select(
        "page_id", "page_title", "seq", F.when(F.col("tag").isin("h1", "b"), F.col("node_text")).alias("mark"))
    section = carry_forward(rows, F.col("mark"), ["page_id"], ["seq"], F.col("page_title"))
    return rows.select("page_id", "seq", F.sha2(section, 256).alias("section"))


CANDIDATES_SQL = NODES + rf"""
, {LATEST_SQL},
fetched AS (SELECT f.*, l.ts, l.http_status, l.error FROM facts f JOIN latest l USING (page_id)),
heads AS (
  SELECT f.page_id, 0 AS kind, arg_min(n.seq, n.seq) AS seq, 'page_section' AS record_type,
    arg_min(trim(rtrim(n.node_text, ':')), n.seq) AS service_name,
    arg_min(trim(rtrim(n.node_text, ':')), n.seq) AS section, f.url AS service_url
  FROM fetched f JOIN inside n USING (page_id)
  WHERE f.error = '' AND n.tag = 'h1' AND length(rtrim(n.node_text, ':')) BETWEEN 4 AND 180
  GROUP BY f.page_id, f.url, replace(lower(rtrim(n.node_text, ':')), 'ß', 'ss')),
resolved AS (
  SELECT f.page_id, f.page_title, n.seq, rtrim(n.node_text, ':') AS title,
    rtrim(regexp_extract(f.url, '^(https?://[^/?#]*)', 1) || split_part(n.href, '#', 1), '/') AS link_url
  FROM fetched f JOIN inside n USING (page_id) WHERE f.error = '' AND n.tag = 'a' AND n.href IS NOT NULL),
linked AS (
  SELECT page_id, 1 AS kind, min(seq) AS seq, 'internal_resource' AS record_type, arg_min(trim(title), seq) AS service_name,
    any_value(page_title) AS section, link_url AS service_url
  FROM resolved WHERE length(title) BETWEEN 4 AND 160 GROUP BY page_id, link_url),
items AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY kind, seq) AS position
  FROM (SELECT * FROM heads UNION ALL SELECT * FROM linked) QUALIFY position <= 30)"""


def page_fetches(t: Tables) -> DataFrame:
    """Latest fetch of each page by its id as a source, with its URL (narrow columns only)."""
    urls = t.pages.select("page_id", "url")
    return urls.join(latest(t), "page_id").select(
        F.col("page_id").cast("string").alias("source_id"), "url", "http_status", "retrieved_at", "error")


def own_pages(t: Tables) -> DataFrame:
    """Pages by their ids as sources: pages may share a URL."""
    return pages(t).withColumn("source_id", F.col("page_id").cast("string"))


def extracted(t: Tables) -> DataFrame:
    """Each fetched page as an approved source of its own; at most thirty records per page."""
    registry = t.pages.select(
        F.col("page_id").cast("string").alias("source_id"), F.lit("Example").alias("organization"), "url",
        F.lit("services").alias("category"), F.lit("general").alias("authority_level"),
        F.startswith("url", F.lit("https:")).alias("own_organisation"), F.lit("approved").alias("scope_status"),
        F.lit("structured_html").alias("extraction_method"))
    return navigator.extract_sources(registry, page_fetches(t), own_pages(t), "source_id", cap=30, heading_tags=("h1",))


@query("page_candidates", CANDIDATES_SQL + """
SELECT substr(sha256(concat_ws(chr(31), CAST(i.page_id AS VARCHAR), i.record_type, i.service_name, i.service_url)), 1, 20) AS record_id,
  CAST(i.page_id AS VARCHAR) AS source_id, f.url LIKE 'https:%' AS own_organisation, i.record_type, i.service_name, i.section,
  f.page_title AS source_page_title, i.service_url, f.content_hash, '' AS safety_notes, 'pending' AS review_status,
  strftime(f.ts, '%Y-%m-%dT%H:%M:%S+00:00') AS retrieved_at, CAST(i.position - 1 AS INTEGER) AS position
FROM items i JOIN fetched f USING (page_id)""")
def page_candidates(t: Tables) -> DataFrame:
    return navigator.candidates(extracted(t)).select(
        "record_id", "source_id", "own_organisation", "record_type", "service_name", "section", "source_page_title",
        "service_url", "content_hash", "safety_notes", "review_status",
        iso_instant("retrieved_at").alias("retrieved_at"), "position")


@query("page_manifest", CANDIDATES_SQL + """
SELECT CAST(f.page_id AS VARCHAR) AS source_id, f.url, f.http_status, CASE WHEN f.error = '' THEN f.page_title ELSE '' END AS page_title,
  '' AS source_last_updated, CASE WHEN f.error = '' THEN f.content_hash ELSE '' END AS content_hash,
  CAST(count(i.page_id) AS INTEGER) AS records_extracted, f.error, strftime(f.ts, '%Y-%m-%dT%H:%M:%S+00:00') AS retrieved_at
FROM fetched f LEFT JOIN items i USING (page_id) GROUP BY ALL""")
def page_manifest(t: Tables) -> DataFrame:
    return navigator.manifest(extracted(t)).withColumn("retrieved_at", iso_instant("retrieved_at"))


@query("review_samples", CANDIDATES_SQL + """
, own AS (
  SELECT i.page_id, i.service_name, row_number() OVER (PARTITION BY CAST(i.page_id AS VARCHAR)
    ORDER BY replace(lower(i.service_name), 'ß', 'ss') COLLATE C, i.position) AS r
  FROM items i JOIN fetched f USING (page_id) WHERE f.url LIKE 'https:%' AND i.record_type = 'page_section')
SELECT CAST(page_id AS VARCHAR) AS source_id, service_name, 'structure_verified' AS review_status,
  CAST(row_number() OVER (ORDER BY r, CAST(page_id AS VARCHAR)) AS INTEGER) AS sample_position
FROM own ORDER BY r, CAST(page_id AS VARCHAR) LIMIT 20""")
def review_samples(t: Tables) -> DataFrame:
    return navigator.review_samples(navigator.candidates(extracted(t)), 20).select(
        "source_id", "service_name", "review_status", "sample_position")


STATUS_SQL = rf"""
WITH {LATEST_SQL},
registry AS (
  SELECT CAST(page_id AS VARCHAR) AS source_id, page_id, url,
    CASE WHEN contains(url, 'spam') OR contains(url, 'casino') THEN 'candidate' ELSE 'approved' END AS scope_status,
    CASE WHEN contains(url, '//m.') THEN 'metadata_only' WHEN contains(url, '//blog.') THEN 'existing_download'
      ELSE 'structured_html' END AS extraction_method
  FROM pages),
evidence AS (SELECT CAST(item_id AS VARCHAR) AS source_id, 'benchmark/' || item_id AS path, length(text) > 200 AS found FROM benchmark)
SELECT r.source_id, r.scope_status, r.extraction_method,
  CASE WHEN scope_status = 'candidate' THEN 'candidate_not_executed'
    WHEN l.page_id IS NOT NULL THEN CASE WHEN l.http_status = 200 THEN 'live_extraction_succeeded' ELSE 'live_extraction_failed' END
    WHEN e.source_id IS NOT NULL THEN CASE WHEN e.found THEN 'existing_local_evidence' ELSE 'local_evidence_missing' END
    WHEN extraction_method = 'metadata_only' THEN 'metadata_only_by_design' ELSE 'not_executed' END AS execution_status,
  CASE WHEN scope_status = 'candidate' THEN '' WHEN l.page_id IS NOT NULL THEN 'navigator_source_manifest'
    WHEN e.source_id IS NOT NULL THEN e.path WHEN extraction_method = 'metadata_only' THEN r.url ELSE '' END AS evidence_location
FROM registry r LEFT JOIN latest l ON l.page_id = r.page_id AND r.extraction_method = 'structured_html' AND l.event_type <> 'signup'
LEFT JOIN evidence e ON e.source_id = r.source_id"""


@query("source_inventory", STATUS_SQL)
def source_inventory(t: Tables) -> DataFrame:
    url = F.col("url")
    registry = t.pages.select(
        F.col("page_id").cast("string").alias("source_id"), url,
        F.when(F.contains(url, F.lit("spam")) | F.contains(url, F.lit("casino")), "candidate").otherwise("approved").alias("scope_status"),
        F.when(F.contains(url, F.lit("//m.")), "metadata_only").when(F.contains(url, F.lit("//blog.")), "existing_download")
        .otherwise("structured_html").alias("extraction_method"))
    structured = registry.where("extraction_method = 'structured_html'").select("source_id")
    manifest = latest(t).where(F.col("event_type") != "signup").select(
        F.col("page_id").cast("string").alias("source_id"), "http_status", "retrieved_at").join(structured, "source_id", "left_semi")
    evidence_rows = t.benchmark.select(
        F.col("item_id").cast("string").alias("source_id"),
        F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("evidence_path"),
        (F.length("text") > 200).alias("evidence_exists"))
    return navigator.inventory(registry, manifest, evidence_rows).select(
        "source_id", "scope_status", "extraction_method", "execution_status", "evidence_location")


SAMPLE_SQL = NODES + """
, para AS (SELECT page_id, arg_min(node_text, seq) AS t FROM inside WHERE tag IN ('p', 'li') AND length(node_text) BETWEEN 60 AND 1200 GROUP BY page_id),
head AS (SELECT page_id, arg_min(node_text, seq) AS t FROM inside WHERE tag IN ('h1', 'h2', 'h3') AND length(node_text) >= 4 GROUP BY page_id),
counted AS (SELECT page_id, CAST(count(CASE WHEN tag IN ('h1', 'h2', 'h3') THEN 1 END) AS INTEGER) AS headings_found,
  CAST(count(CASE WHEN tag = 'a' AND href IS NOT NULL THEN 1 END) AS INTEGER) AS links_found,
  COALESCE(arg_min(CASE WHEN tag = 'title' THEN node_text END, seq) FILTER (tag = 'title'), '') AS title
  FROM nodes GROUP BY page_id),
sample AS (
  SELECT x.page_id, c.title AS page_title, c.headings_found, c.links_found,
    CASE WHEN p.t IS NOT NULL THEN 'paragraph_or_list' WHEN h.t IS NOT NULL THEN 'heading' WHEN whole <> '' THEN 'page_text' ELSE '' END AS sample_type,
    substr(COALESCE(p.t, h.t, whole), 1, 600) AS parsed_sample
  FROM page_text x JOIN counted c USING (page_id) LEFT JOIN para p USING (page_id) LEFT JOIN head h USING (page_id))"""


@query("parse_samples", SAMPLE_SQL + f"""
, {LATEST_SQL},
joined AS (
  SELECT g.page_id, g.url, l.http_status, l.error, COALESCE(l.error = '', FALSE) AS ok, NOT contains(g.url, '//blog.') AS html,
    octet_length(encode(g.html)) AS n_bytes
  FROM pages g LEFT JOIN latest l USING (page_id))
SELECT CAST(j.page_id AS VARCHAR) AS source_id, j.url, CASE WHEN ok THEN j.http_status ELSE 0 END AS http_status,
  CASE WHEN NOT ok THEN '' WHEN html THEN 'text/html' ELSE 'application/pdf' END AS content_type,
  CASE WHEN ok AND html THEN page_title ELSE '' END AS page_title,
  CASE WHEN NOT ok THEN '' WHEN html THEN sample_type ELSE 'non_html_metadata' END AS sample_type,
  CASE WHEN NOT ok THEN '' WHEN html THEN parsed_sample ELSE 'Downloaded non-HTML content with type application/pdf and '
    || format('{{:,}}', n_bytes) || ' bytes.' END AS parsed_sample,
  CASE WHEN ok AND html THEN headings_found ELSE 0 END AS headings_found,
  CASE WHEN ok AND html THEN links_found ELSE 0 END AS links_found,
  COALESCE(ok AND (NOT html OR parsed_sample <> ''), FALSE) AS parseable, COALESCE(j.error, '') AS error
FROM joined j JOIN sample s USING (page_id)""")
def parse_samples(t: Tables) -> DataFrame:
    return sample_rows(t).select(
        "source_id", "url", "http_status", "content_type", "page_title", "sample_type", "parsed_sample",
        "headings_found", "links_found", "parseable", "error")


def sample_rows(t: Tables) -> DataFrame:
    inventory = t.pages.select(
        F.col("page_id").cast("string").alias("source_id"), F.lit("approved").alias("scope_status"),
        F.lit("Example").alias("organization"), F.lit("services").alias("category"), "url")
    html = ~F.contains("url", F.lit("//blog."))
    bodies = own_pages(t).select(
        "source_id", "url", F.when(html, "text/html; charset=utf-8").otherwise("application/pdf").alias("content_type"),
        F.when(html, F.col("html")).otherwise("%PDF").alias("body"), F.octet_length("html").alias("n_bytes"))
    fetches = page_fetches(t).withColumn("final_url", F.col("url"))
    return evidence.url_parse_samples(inventory, fetches, bodies, "source_id")


FRAGMENTS = ("copyright", "ououan")
PARAGRAPHS_SQL = NODES + """
, para AS (
  SELECT page_id, seq, tag = 'li' AS is_li, node_text, replace(lower(node_text), 'ß', 'ss') AS folded FROM inside
  WHERE tag IN ('p', 'li') AND length(node_text) BETWEEN 55 AND 900
    AND NOT contains(replace(lower(node_text), 'ß', 'ss'), 'copyright') AND NOT contains(replace(lower(node_text), 'ß', 'ss'), 'ououan')),
unique_para AS (
  SELECT * FROM para QUALIFY row_number() OVER (PARTITION BY page_id, folded ORDER BY is_li, seq) = 1),
ranked_para AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY is_li, seq) AS INTEGER) AS position FROM unique_para)"""


@query("useful_paragraphs", PARAGRAPHS_SQL + """
SELECT page_id, seq, position, node_text AS paragraph FROM ranked_para""")
def useful_paragraphs(t: Tables) -> DataFrame:
    """Every distinct meaningful paragraph of each page's first root that has one, in reading order."""
    from pyspark.sql import Window

    from signpost.functions.text import contains_any, present

    content = X.first_root_with_paragraphs(FRAGMENTS)
    parsed = parse_pages(pages(t), ["page_id"]).select("*", F.explode(present(content)).alias("content"))
    sized = lambda n: n["tag"].isin("p", "li") & n["text_len"].between(55, 900)
    found = parsed.select("page_id", "text_pieces", "nodes", F.col("content.root").alias("root"))
    rows = node_table(found, ["page_id", "root"], sized).where(
        F.col("seq").between(F.col("root.seq") + 1, F.col("root.end_seq"))
    ).select("page_id", "seq", (F.col("tag") == "li").alias("is_li"), F.col("node_text").alias("paragraph"))
    rows = rows.withColumn("folded", casefold("paragraph")).where(~contains_any(F.col("folded"), FRAGMENTS))
    unique = first_per_key(rows, ["page_id", "folded"], ["is_li", "seq"])
    position = F.row_number().over(Window.partitionBy("page_id").orderBy("is_li", "seq"))  # within one page
    return unique.withColumn("position", position).select("page_id", "seq", "position", "paragraph")


KEYWORDS = ("th", "contact")
METHODS_SQL = r"""
, methods AS (
  SELECT n.page_id, n.node_text || ': ' || regexp_extract(f.url, '^(https?://[^/?#]*)', 1) || n.href AS method, min(n.seq) AS seq
  FROM inside n JOIN facts f USING (page_id)
  WHERE n.tag = 'a' AND n.href IS NOT NULL AND n.node_text <> ''
    AND (contains(replace(lower(n.node_text), 'ß', 'ss'), 'th') OR contains(replace(lower(n.node_text), 'ß', 'ss'), 'contact'))
  GROUP BY ALL),
method_list AS (
  SELECT page_id, string_agg(method, ' | ' ORDER BY seq) AS methods
  FROM (SELECT * FROM methods QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY seq) <= 4) GROUP BY page_id)"""


@query("contact_links", NODES + METHODS_SQL + """
SELECT g.page_id, COALESCE(methods, g.url) AS contact_or_access_methods FROM pages g LEFT JOIN method_list USING (page_id)""")
def contact_links(t: Tables) -> DataFrame:
    from signpost.functions.text import join_or

    facts = with_page_facts(parse_pages(pages(t), ["page_id", "url"]))
    return facts.select(
        "page_id", join_or(X.access_methods(F.col("root"), KEYWORDS), "url").alias("contact_or_access_methods"))


@query("useful_records", PARAGRAPHS_SQL + rf"""
, {LATEST_SQL},
two AS (
  SELECT page_id, substr(string_agg(node_text, ' ' ORDER BY position), 1, 900) AS service_description,
    substr(arg_min(node_text, position), 1, 500) AS excerpt
  FROM ranked_para WHERE position <= 2 GROUP BY page_id),
status AS (SELECT g.url, l.http_status FROM pages g JOIN latest l USING (page_id))
SELECT CAST(g.page_id AS VARCHAR) AS service_id, t.service_description, t.excerpt AS source_evidence_excerpt, g.url AS source_url,
  rtrim(g.url, '/') || '/next' AS contact_or_access_methods, s.http_status AS source_http_status, 0 AS next_step_http_status,
  '2024-02-01' AS last_verified_date, 'content_verified_for_proposal' AS review_status,
  sha256(concat_ws(chr(31), CAST(g.page_id AS VARCHAR), 'Service ' || g.page_id, 'services', 'all', t.service_description, 'online',
    rtrim(g.url, '/') || '/next', 'read', rtrim(g.url, '/') || '/next', g.url, t.excerpt, CAST(s.http_status AS VARCHAR), '0', '2024-02-01',
    'none', 'content_verified_for_proposal')) AS content_hash
FROM pages g JOIN latest l USING (page_id) JOIN status s ON s.url = g.url JOIN two t USING (page_id) WHERE l.error = ''""")
def useful_records(t: Tables) -> DataFrame:
    return useful_rows(t).select(
        "service_id", "service_description", "source_evidence_excerpt", "source_url", "contact_or_access_methods",
        "source_http_status", "next_step_http_status", "last_verified_date", "review_status", "content_hash")


def service_specs(t: Tables) -> DataFrame:
    """Each page as a specified service."""
    return t.pages.select(
        F.col("page_id").cast("string").alias("service_id"),
        F.concat(F.lit("Service "), F.col("page_id").cast("string")).alias("service_name"), F.lit("services").alias("category"),
        F.col("url").alias("source_url"), F.lit("all").alias("intended_users"), F.lit("online").alias("delivery_context"),
        F.lit("read").alias("recommended_next_step"),
        F.concat(F.rtrim("url", F.lit("/")), F.lit("/next")).alias("next_step_url"), F.lit("none").alias("limitation"))


def useful_rows(t: Tables) -> DataFrame:
    """``ououan`` stands for the organisation's own boilerplate."""
    run = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    fetches, own = (df.withColumnRenamed("source_id", "service_id") for df in (page_fetches(t), own_pages(t)))
    return evidence.useful_records(service_specs(t), fetches, own, run, fragments=FRAGMENTS, key="service_id")
