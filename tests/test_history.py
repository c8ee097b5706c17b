"""As-of joins, counts that merge over loads, and the latest row kept over a feed."""

import random

from pyspark.sql import functions as F

from signpost.operators import merging as M
from signpost.operators.asof import as_of_join
from signpost.operators.ordering import last_per_key
from signpost.plans import specified as P
from signpost.streaming import feeds


def in_force(left, right):
    """By hand: the latest of ``right`` (key, time, id) for every (row, key, time)."""
    out = {}
    for row, key, time in left:
        seen = [(t, i) for k, t, i in right if k is not None and k == key and t is not None and time is not None and t <= time]
        out[row] = max(seen, default=(None, None))
    return out


def test_as_of_join_equals_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", "c", None])
    time = lambda: rng.choice([None, *range(60)])
    right = [(key(), time(), i) for i in range(400)]
    left = [(i, key(), time()) for i in range(600)] + [(600, "never fetched", 5), (601, "a", -1)]
    lefts = spark.createDataFrame(left, "row int, url string, at int").repartition(7)
    rights = spark.createDataFrame(right, "url string, at int, id int").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions stay apart
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        joined = as_of_join(lefts, rights, ["url"], "at", "at", ["id"])
        assert joined.columns == ["row", "url", "at", "in_force"]
        rows = joined.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {r.row: (r.in_force.at, r.in_force.id) if r.in_force else (None, None) for r in rows}
    assert len(rows) == len(left) and got == in_force(left, right)


def test_as_of_join_without_rows_on_a_side(spark):
    lefts = spark.createDataFrame([(1, "a", 3)], "row int, url string, at int")
    rights = spark.createDataFrame([], "url string, at int, id int")
    assert [tuple(r) for r in as_of_join(lefts, rights, ["url"], "at", "at").collect()] == [(1, "a", 3, None)]
    assert as_of_join(lefts.where("false"), rights, ["url"], "at", "at").collect() == []


def test_links_and_freshness_at_several_dates(spark):
    records = spark.createDataFrame([("r", "u"), ("s", "v"), ("t", "")], "record_id string, official_source_url string")
    fetches = spark.createDataFrame(
        [("u", 200, "2026-01-01"), ("u", 404, "2026-01-05"), ("u", 200, "2026-01-09"), ("v", 0, "2026-01-02")],
        "url string, http_status int, at string").withColumn("retrieved_at", F.col("at").cast("timestamp")).drop("at")
    moments = ["2026-01-04", "2026-01-06", "2026-01-10"]
    broken = P.broken_links_as_of(records, fetches, moments).collect()
    assert sorted((r.record_id, r.as_of.day, r.http_status) for r in broken) == [
        ("r", 6, 404), ("s", 4, 0), ("s", 6, 0), ("s", 10, 0)]
    stale = P.stale_records_as_of(records, fetches, moments, 3).collect()
    assert sorted((r.record_id, r.as_of.day, r.age_days) for r in stale) == [
        ("r", 6, 5), ("s", 4, None), ("s", 6, None), ("s", 10, None)]


def test_records_that_share_a_url_are_judged_by_their_own_fetches(spark):
    records = spark.createDataFrame([("r", "u"), ("s", "u"), ("t", "u")], "record_id string, official_source_url string")
    fetches = spark.createDataFrame(
        [("r", 200, "2026-01-01"), ("s", 404, "2026-01-02")], "record_id string, http_status int, at string"
    ).withColumn("retrieved_at", F.col("at").cast("timestamp")).drop("at")
    assert {(r.record_id, r.http_status) for r in P.broken_links(records, fetches, own=True).collect()} == {("s", 404), ("t", -1)}
    broken = P.broken_links_as_of(records, fetches, ["2026-01-04"], own=True).collect()
    assert {(r.record_id, r.http_status) for r in broken} == {("s", 404), ("t", -1)}
    stale = P.stale_records_as_of(records, fetches, ["2026-01-10"], 3, own=True).collect()
    assert {(r.record_id, r.age_days) for r in stale} == {("r", 9), ("s", None), ("t", None)}


def test_counts_of_two_loads_equal_those_of_their_union(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), f"v{rng.randrange(50_000)}" if rng.random() < 0.9 else None) for _ in range(60_000)] + [("d", None)]
    schema = "kind string, value string"
    first, second = spark.createDataFrame(rows[:25_000], schema), spark.createDataFrame(rows[25_000:], schema)
    known = M.extended_ids(None, first, "value")
    grown = M.extended_ids(known, second, "value")
    numbers = [r.id for r in grown.collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))
    assert known.exceptAll(grown).count() == 0
    parts = [M.distinct_parts(M.with_ids(load, ids, "value"), ["kind"], "id") for load, ids in ((first, known), (second, grown))]
    got = {r.kind: (r["values"], r.rows) for r in M.distinct_totals(M.merged_parts(*parts), ["kind"]).collect()}
    want = {k: (len({v for kk, v in rows if kk == k and v is not None}), sum(kk == k for kk, _ in rows)) for k in "abcd"}
    assert got == want and want["d"] == (0, 1)
    nothing = M.distinct_parts(M.with_ids(first.where("false"), grown, "value"), ["kind"], "id")
    assert M.distinct_totals(nothing, ["kind"]).collect() == []


def test_last_row_per_id_survives_replay_and_disorder(spark, tmp_path):
    schema = "url string, at int, status int"
    loads = [[("u", 5, 200), ("v", 1, 0)], [("u", 3, 404), ("v", 2, 200), (None, 1, 1)], [("u", 5, 200), ("w", None, 0)], [("w", 4, 200), ("v", 2, 200)]]
    where = [str(tmp_path / n) for n in ("in", "out", "state")]
    for load in loads:
        spark.createDataFrame(load, schema).coalesce(1).write.mode("append").parquet(where[0])
        stream = feeds.read_feed(spark, where[0], spark.createDataFrame([], schema).schema, maxFilesPerTrigger=1)
        feeds.keep_last(stream, ["url"], ["at", "status"], *where[1:]).awaitTermination()
    got = feeds.last_rows(spark, where[1], ["url"], ["at", "status"])
    batch = last_per_key(spark.read.parquet(where[0]), ["url"], ["at", "status"])
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
    assert {(r.url, r.at, r.status) for r in got.collect()} == {("u", 5, 200), ("v", 2, 200), (None, 1, 1), ("w", 4, 200)}
