import random

import pytest
from pyspark.sql import functions as F

from signpost.operators import ordering as G
from signpost.sources.tables import listing_until_empty, only_urls, with_fetch_outcome


def sample_rows(n=200, seed=3):
    rng = random.Random(seed)
    # One key holds a third of all rows.
    return [(i, "hot" if rng.random() < 1 / 3 else f"k{rng.randint(0, 9)}", rng.choice("aAbBß")) for i in range(n)]


def frames(spark):
    rows = sample_rows()
    for order in (rows, rows[::-1], random.Random(1).sample(rows, len(rows))):
        for parts in (1, 7):
            yield spark.createDataFrame(order, "seq int, key string, name string").repartition(parts)


def test_first_last_and_cap_do_not_depend_on_layout(spark):
    rows = sample_rows()
    first, last, capped = {}, {}, {}
    for r in rows:
        first.setdefault(r[1], r[0])
        last[r[1]] = r[0]
        capped.setdefault(r[1], []).append(r[0])
    for df in frames(spark):
        assert {r.key: r.seq for r in G.first_per_key(df, ["key"], ["seq"]).collect()} == first
        assert {r.key: r.seq for r in G.last_per_key(df, ["key"], ["seq"]).collect()} == last
        got = {}
        for r in G.top_per_key(df, ["key"], ["seq"], 4, rank="rank").collect():
            got.setdefault(r.key, {})[r["rank"]] = r.seq
        assert got == {k: dict(enumerate(v[:4], 1)) for k, v in capped.items()}


def test_cap_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame(sample_rows(), "seq int, key string, name string")
    plan = G.top_per_key(df, ["key"], ["seq"], 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


@pytest.mark.parametrize("n", [1, 5, 20, 500])
def test_round_robin_equals_the_loop(spark, n):
    rows = sample_rows(60)
    by_key = {}
    for r in rows:
        by_key.setdefault(r[1], []).append(r)
    for v in by_key.values():
        v.sort(key=lambda r: (r[2].casefold(), r[0]))
    want, keys = [], sorted(by_key)
    while len(want) < n and keys:
        for k in list(keys):
            if by_key[k]:
                want.append(by_key[k].pop(0)[0])
            if not by_key[k]:
                keys.remove(k)
            if len(want) == n:
                break
    df = spark.createDataFrame(rows, "seq int, key string, name string").repartition(5)
    got = G.round_robin(df, "key", "name", n, "seq").orderBy("sample_position").collect()
    assert [r.seq for r in got] == want


def test_carry_forward_and_ordered_list(spark):
    df = spark.createDataFrame([("p", 1, None), ("p", 2, "A"), ("p", 3, None), ("p", 4, "B"), ("q", 1, None)], "page string, seq int, mark string")
    out = df.withColumn("s", G.carry_forward(df, F.col("mark"), ["page"], ["seq"], F.lit("title")))
    assert [r.s for r in out.orderBy("page", "seq").collect()] == ["title", "A", "A", "B", "title"]
    lists = df.repartition(4).groupBy("page").agg(G.ordered_list(F.col("mark"), F.col("seq")).alias("x"))
    assert {r.page: r.x for r in lists.collect()}["p"] == [None, "A", None, "B"]


def test_listing_stops_at_the_first_empty_page(spark):
    def page(i, n, cards):
        return (i, n, [(c,) for c in cards])
    df = spark.createDataFrame(
        [page("a", 1, ["x", "y"]), page("a", 2, ["z"]), page("a", 3, []), page("a", 4, ["late"]), page("b", 1, ["q"]), page("b", 9, ["far"]), page("c", 1, [])],
        "list_id string, page_no int, cards array<struct<word:string>>")
    got = sorted((r.list_id, r.page_no, r.card_no, r.word) for r in listing_until_empty(df, 8).collect())
    assert got == [("a", 1, 0, "x"), ("a", 1, 1, "y"), ("a", 2, 0, "z"), ("b", 1, 0, "q")]


def test_fetch_log_keeps_failures(spark):
    log = spark.createDataFrame([("u1", 200, ""), ("u2", 0, "offline"), ("u3", 200, "")], "url string, status int, error string")
    read = spark.createDataFrame([("u1", "T"), ("u2", "stale")], "url string, title string")
    assert {r.url: r.title for r in with_fetch_outcome(log, read, ["title"]).collect()} == {"u1": "T", "u2": None, "u3": None}
    wanted = spark.createDataFrame([("u2",), ("u2",)], "url string")
    assert [r.url for r in only_urls(read, wanted).collect()] == ["u2"]
