"""First/last per key, caps, samples and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.functions.text import casefold, digest, iso_instant
from signpost.operators import ordering as G
from signpost.queries.registry import Tables, query
from signpost.session import new_folder
from signpost.sources.tables import listing_until_empty
from signpost.streaming import feeds

PREVIEW_ROWS = 100


def fetch_log(t: Tables) -> DataFrame:
    """Events as fetches of the page whose id is the user id; an error event is a failed fetch."""
    failed = F.col("event_type") == "error"
    return t.events.select(
        F.col("user_id").alias("page_id"), F.col("ts").alias("retrieved_at"), "event_id", "event_type",
        F.when(failed, 0).otherwise(200).alias("http_status"),
        F.when(failed, F.concat(F.lit("failed:"), F.col("event_id").cast("string"))).otherwise("").alias("error"))


def latest(t: Tables) -> DataFrame:
    return G.last_per_key(fetch_log(t), ["page_id"], ["retrieved_at", "event_id"])


LATEST_SQL = """latest AS (
  SELECT user_id AS page_id, ts, event_id, event_type, CASE WHEN event_type = 'error' THEN 0 ELSE 200 END AS http_status,
    CASE WHEN event_type = 'error' THEN 'failed:' || event_id ELSE '' END AS error
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


@query("latest_fetch", f"""
WITH {LATEST_SQL}
SELECT page_id, event_id, http_status, error, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS retrieved_at FROM latest""")
def latest_fetch(t: Tables) -> DataFrame:
    return latest(t).drop("event_type").withColumn("retrieved_at", iso_instant("retrieved_at"))


@query("latest_fetch_feed", f"""
WITH {LATEST_SQL}
SELECT page_id, event_id, http_status, error, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS retrieved_at FROM latest""")
def latest_fetch_feed(t: Tables) -> DataFrame:
    """The fetch log as a feed of files in no order of time, a third of them in each micro-batch."""
    files = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    log = fetch_log(t).drop("event_type")
    folder = new_folder(t.spark, "feed")
    log.repartition(files, "event_id").write.parquet(f"{folder}/in")
    stream = feeds.read_feed(t.spark, f"{folder}/in", log.schema, maxFilesPerTrigger=max(1, files // 3))
    keys, order = ["page_id"], ["retrieved_at", "event_id"]
    feeds.keep_last(stream, keys, order, f"{folder}/out", f"{folder}/state").awaitTermination()
    return feeds.last_rows(t.spark, f"{folder}/out", keys, order).withColumn("retrieved_at", iso_instant("retrieved_at"))


@query("dedupe_last", """
SELECT sha256(text) AS record_id, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY 1""")
def dedupe_last(t: Tables) -> DataFrame:
    rows = t.documents.select(digest("text").alias("record_id"), "doc_id", "source")
    return G.last_per_key(rows, ["record_id"], ["doc_id"])


@query("dedupe_first_casefold", """
SELECT source, replace(lower(text), 'ß', 'ss') AS title_key, min(doc_id) AS doc_id,
  arg_min(text, doc_id) AS title FROM documents GROUP BY ALL""")
def dedupe_first_casefold(t: Tables) -> DataFrame:
    rows = t.documents.select("source", "doc_id", F.col("text").alias("title")).withColumn("title_key", casefold("title"))
    return G.first_per_key(rows, ["source", "title_key"], ["doc_id"])


@query("cap_per_source", """
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error' DESC, ts, event_id) AS INTEGER)
  AS position FROM events QUALIFY position <= 30""")
def cap_per_source(t: Tables) -> DataFrame:
    order = [F.when(F.col("event_type") == "error", 0).otherwise(1), "ts", "event_id"]
    return G.top_per_key(t.events, ["user_id"], order, 30, rank="position").select("user_id", "event_id", "position")


@query("round_robin_sample", """
SELECT p_brand, p_partkey, p_name, CAST(row_number() OVER (ORDER BY r, p_brand) AS INTEGER) AS sample_position FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) AS r FROM part)
ORDER BY r, p_brand LIMIT 20""")
def round_robin_sample(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", "p_partkey", "p_name")
    return G.round_robin(rows, "p_brand", "p_name", 20, "p_partkey")


@query("listing_until_empty", r"""
WITH p AS (SELECT conv_id AS list_id, CAST(turn AS INTEGER) + 1 AS page_no, text,
    list_filter(string_split(text, ' '), lambda w: length(w) > 9) AS cards FROM conversations),
stop AS (SELECT list_id, min(CASE WHEN len(cards) = 0 THEN page_no END) AS stop_at FROM p GROUP BY 1),
kept AS (SELECT p.* FROM p JOIN stop USING (list_id) WHERE (stop_at IS NULL OR page_no < stop_at))
SELECT list_id, page_no, CAST(generate_subscripts(cards, 1) - 1 AS INTEGER) AS card_no, unnest(cards) AS word FROM kept""")
def listing_pages(t: Tables) -> DataFrame:
    words = F.filter(F.split("text", " "), lambda w: F.length(w) > 9)
    pages = t.conversations.select(
        F.col("conv_id").alias("list_id"), (F.col("turn").cast("int") + 1).alias("page_no"),
        F.transform(words, lambda w: F.struct(w.alias("word"))).alias("cards"))
    return listing_until_empty(pages)


@query("preview_first_rows", """
SELECT doc_id, CAST(row_number() OVER (ORDER BY lang, source, replace(lower(text), 'ß', 'ss') COLLATE C, doc_id) AS INTEGER) AS position
FROM documents ORDER BY position LIMIT 100""")
def preview_first_rows(t: Tables) -> DataFrame:
    """The report preview: first ``PREVIEW_ROWS`` rows of the presentation sort, a top-k and not a full sort."""
    from pyspark.sql import Window

    top = t.documents.select("doc_id", "lang", "source", casefold("text").alias("folded")).orderBy(
        "lang", "source", "folded", "doc_id").limit(PREVIEW_ROWS)
    return top.withColumn(
        "position", F.row_number().over(Window.orderBy("lang", "source", "folded", "doc_id"))).select("doc_id", "position")
