from pyspark.sql import functions as F

from signpost import schemas as S
from signpost.plans import navigator
from signpost.sources.files import conform
from signpost.streaming import feeds


def test_intakes_are_ranked_per_batch(spark, tmp_path):
    records = conform(spark.createDataFrame([("a", "Tax desk", "tax", "Tax")], "record_id string, service_name string, category_id string, category_label string"), S.SERVICE_RECORDS)
    schema = "intake_id int, main_need string, urgency_level string"
    feed = spark.createDataFrame([(1, "tax", "routine"), (2, "zzz", "routine")], schema)
    feed.write.parquet(str(tmp_path / "in"))
    for extra in (None, [(3, "desk", "emergency")]):
        if extra:
            spark.createDataFrame(extra, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feeds.read_feed(spark, str(tmp_path / "in"), feed.schema)
        feeds.rank_intakes(stream, records, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.intake_id, r.score, r.emergency_notice is not None) for r in rows) == [(1, 3, False), (3, 1, True)]


def test_pages_stream_through_extraction(spark, tmp_path):
    sources = spark.createDataFrame(
        [("s", "O", "c", "general", True, "https://a.ca", 200, "", "<main><h2>Get help</h2></main>")],
        "source_id string, organization string, category string, authority_level string, own_organisation boolean, url string,"
        " http_status int, error string, html string").withColumn("retrieved_at", F.lit("2026-06-12").cast("timestamp"))
    sources.write.parquet(str(tmp_path / "in"))
    stream = feeds.read_feed(spark, str(tmp_path / "in"), sources.schema)
    feeds.extract_pages(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [r.service_name for r in navigator.candidates(out).collect()] == ["Get help"]
