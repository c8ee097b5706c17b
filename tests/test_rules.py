import math
import random

import pytest
from pyspark.sql import functions as F

from signpost import schemas as S
from signpost.operators import quality as Q
from signpost.operators.nearest import EARTH_KM, nearest
from signpost.plans import reports
from signpost.plans import specified as P
from signpost.sources.files import taxonomy

REC = ("record_id string, service_name string, category_id string, category_label string, student_need string,"
       " authority_level string, student_type string, location string, last_verified_date string, official_source_url string")


def direct_precedence(intake, records, ranks, limit=3):
    need, urgency, stype, place = intake
    query, emergency = need.strip().lower(), urgency.strip().lower() == "emergency"
    rows = []
    for rid, name, cid, label, sneed, auth, rtype, rplace, date, _ in records:
        hay = " ".join(x or "" for x in (cid, label, sneed, name)).lower()
        score = (2 if query == cid.lower() else 0) + (1 if query and query in hay else 0)
        safe = cid == "safety_urgent"
        if not score and not (emergency and safe):
            continue
        rows.append((1 if emergency and not safe else 0, -score, ranks.get(auth, 99),
                     0 if stype and rtype == stype else 1 if not rtype else 2,
                     0 if place and rplace == place else 1, date is None, [-int(x) for x in (date or "0").split("-")], name, rid))
    return [r[-1] for r in sorted(rows)[:limit]]


@pytest.mark.parametrize("seed", [1, 2])
def test_precedence_equals_the_direct_rule(spark, seed):
    rng = random.Random(seed)
    types, places = ["", "international", "graduate"], ["", "downtown", "west"]
    records = [(f"r{i:03d}", rng.choice(["Help", "Tax desk", "Care"]), rng.choice(["tax", "health_care", "safety_urgent", ""]),
                rng.choice(["Tax", "Care"]), rng.choice([None, "tax return", "care"]), rng.choice(["own", "gov", "other"]),
                rng.choice(types), rng.choice(places), rng.choice([None, "2026-01-02", "2026-03-04"]), None) for i in range(150)]
    asked = [(n, u, t, p) for n in ("tax", "care", " Health_Care", "zzz", "") for u in ("emergency", "routine") for t in types for p in places[:2]]
    intakes = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "id int, main_need string, urgency_level string, student_type string, location string")
    authority = spark.createDataFrame([("own", 1), ("gov", 2)], "authority_level string, authority_rank int")
    got = {}
    for r in P.rank_with_precedence(intakes, spark.createDataFrame(records, REC).repartition(3), authority).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.record_id)
    for i, a in enumerate(asked):
        assert got.get(i, []) == direct_precedence(a, records, {"own": 1, "gov": 2}), a


def test_only_approved_records_pass(spark):
    df = spark.createDataFrame([("a", "approved"), ("b", "pending"), ("c", None)], "record_id string, review_status string")
    assert [r.record_id for r in P.approved(df).collect()] == ["a"]


def test_scenarios(spark):
    scenarios = spark.createDataFrame([
        ("hit", ["tax"], ["Desk"], True, True), ("wrong", ["tax"], ["Other"], False, True), ("nolink", ["tax"], ["Desk"], False, True),
        ("nonote", ["tax"], ["Desk"], True, False), ("none", ["tax"], ["Desk"], False, False)],
        "scenario_id string, expected_categories array<string>, acceptable_services array<string>, must_include_safety_note boolean, must_include_source_link boolean")
    m = [("hit", "tax", "Desk", "u", True), ("hit", "x", "Y", "u", False), ("wrong", "tax", "Desk", "u", True), ("nolink", "tax", "Desk", "", False), ("nonote", "tax", "Desk", "", False)]
    matches = spark.createDataFrame(m, "scenario_id string, category_id string, service_name string, official_source_url string, limitation_required boolean")
    rows = {r.scenario_id: r for r in P.evaluate_scenarios(scenarios, matches).collect()}
    assert {k: r.passed for k, r in rows.items()} == {"hit": True, "wrong": False, "nolink": False, "nonote": False, "none": False}
    assert not rows["nolink"].source_ok and not rows["nonote"].safety_ok and rows["none"].returned == 0
    total = P.evaluation_by(P.evaluate_scenarios(scenarios, matches).withColumn("all", F.lit(1)), "all").collect()[0]
    assert (total.scenarios, total.passed, total.failed, total.meets_target) == (5, 1, 4, False)


def test_scenarios_alike_are_evaluated_once(spark):
    scenarios = spark.createDataFrame(
        [(f"s{i}", "tax" if i < 7 else None, ["tax"], ["Desk" if i < 4 else "Other"], False, False) for i in range(9)],
        "scenario_id string, main_need string, expected_categories array<string>, acceptable_services array<string>, "
        "must_include_safety_note boolean, must_include_source_link boolean")
    cases = P.scenario_cases(scenarios)
    assert {r.scenario_id: r.scenarios for r in cases.collect()} == {"s0": 4, "s4": 3, "s7": 2}
    matches = cases.where("main_need = 'tax'").select(
        "scenario_id", F.lit("tax").alias("category_id"), F.lit("Desk").alias("service_name"), F.lit("u").alias("official_source_url"),
        F.lit(False).alias("limitation_required"))
    results = P.evaluate_scenarios(cases, matches)
    each = {r.scenario_id: (r.returned, r.passed) for r in P.results_of_cases(scenarios, cases, results).collect()}
    assert each == {f"s{i}": (int(i < 7), i < 4) for i in range(9)}
    counted = results.join(cases.select("scenario_id", "main_need", "scenarios"), "scenario_id")
    rows = {r.main_need: r for r in P.evaluation_by(counted, "main_need", 0.5, "scenarios").collect()}
    assert (rows["tax"].scenarios, rows["tax"].passed, rows["tax"].failed, rows["tax"].meets_target) == (7, 4, 3, True)
    assert (rows[None].scenarios, rows[None].passed, rows[None].failed, rows[None].meets_target) == (2, 0, 2, False)


def test_fallback_rows_name_no_service(spark):
    intakes = spark.createDataFrame([(1, "tax"), (2, "housing"), (3, "weather")], "id int, main_need string")
    matches = spark.createDataFrame([(1, 1, "r", "Desk", 3)], "id int, rank int, record_id string, service_name string, score int")
    rows = {r.id: r for r in P.with_fallback(intakes, matches, "id", taxonomy(spark)).collect()}
    assert [rows[i].outcome for i in (1, 2, 3)] == ["matched", "no_match", "unsupported"]
    assert rows[2].service_name is None and rows[3].fallback == P.UNSUPPORTED_MESSAGE and rows[1].fallback == ""


def test_maintenance_reports(spark):
    df = spark.createDataFrame([("a", "2026-01-01", "https://a.ca"), ("b", "", "https://b.ca"), ("c", "2026-06-01", ""), ("d", "soon", "https://d.ca")],
                               "record_id string, last_verified_date string, official_source_url string")
    run = F.lit("2026-06-12").cast("date")
    assert {(r.record_id, r.age_days) for r in P.stale_records(df, run, 90).collect()} == {("a", 162), ("b", None), ("d", None)}
    log = spark.createDataFrame([("https://a.ca", 200), ("https://b.ca", 404)], "url string, http_status int")
    assert {(r.record_id, r.http_status) for r in P.broken_links(df, log).collect()} == {("b", 404), ("d", -1)}
    dates = spark.createDataFrame([("June 9, 2026",), ("soon",), ("",)], "t string").select(P.page_dates("t").alias("d")).collect()
    assert [str(r.d) for r in dates] == ["2026-06-09", "None", "None"]


def test_coverage_and_conformance(spark):
    df = spark.createDataFrame([("tax", True), ("tax", False), ("odd", True), ("healthcare", False)], "category_id string, own boolean")
    rows = {r.category_id: (r.records, r.own_records) for r in P.category_coverage(df, taxonomy(spark), F.col("own")).collect()}
    assert len(rows) == 12 and rows["tax"] == (2, 1) and rows["housing"] == (0, 0)
    mapping = spark.createDataFrame([("healthcare", "health_care")], "category string, category_id string")
    assert {r.category for r in P.outside_taxonomy(df, taxonomy(spark)).collect()} == {"odd", "healthcare"}
    assert {r.category for r in P.outside_taxonomy(df, taxonomy(spark), category_map=mapping).collect()} == {"odd"}
    targets = {r.measure: (r.value, r.met) for r in P.directory_targets(df, F.col("own"), ("healthcare",)).collect()}
    assert targets["records"] == (4, False) and targets["health_records"] == (1, False)


def test_sensitive_text_rules(spark):
    texts = ["my sin is 123-456-789", "id 260123456 ok", "passport AB123456.", "write me: a.b@c.org", "card 1234 5678 9012 3456", "plain 12345 text", "ABCD 1234 5678"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in P.sensitive_text(df, ["id"], "text").collect():
        got.setdefault(r.id, set()).add(r.rule)
    assert got == {0: {"social_insurance_number"}, 1: {"nine_digit_identifier"}, 2: {"passport_number"}, 3: {"email_address"},
                   4: {"account_number"}, 6: {"health_card_number"}}


def test_conflicts_facets_rules_provenance_backup(spark):
    claims = spark.createDataFrame([("e", "fee", "1"), ("e", "fee", "2"), ("e", "hours", "9"), ("f", "fee", "1"), ("f", "fee", "")], "entity string, field string, value string")
    assert [tuple(r) for r in P.conflicting_claims(claims, ["entity"], "field", "value").collect()] == [("e", "fee", 2, "1", "2")]
    rows = P.facet_counts(claims, ["entity", "field"], {"entity": ["e"]}).collect()
    assert {(r.facet, r.value): r.records for r in rows} == {("entity", "e"): 3, ("field", "fee"): 2, ("field", "hours"): 1}
    rules = spark.createDataFrame([("e", "value", "required"), ("f", "value", "not_applicable")], "record_type string, field string, kind string")
    assert {(r.record_type, r.kind, r.missing) for r in P.missing_by_rule(claims, "entity", ["value"], rules).collect()} == {("e", "required", 0), ("f", "not_applicable", 1)}
    fac = spark.createDataFrame([("x", *["v"] * 7), ("y", "v", "", "v", None, "v", "v", "v")], "facility_id string, " + ", ".join(f"{f} string" for f in S.PROVENANCE_FIELDS))
    assert [tuple(r) for r in P.incomplete_provenance(fac).collect()] == [("y", "source_publisher,source_license_or_terms")]
    matches = spark.createDataFrame([(1, 1, "a", "A"), (1, 2, "b", "B"), (1, 3, "c", "C"), (2, 1, "a", "A")], "id int, rank int, record_id string, service_name string")
    assert sorted(tuple(r) for r in P.primary_and_backup(matches, "id").collect()) == [(1, "a", "A", "b", "B"), (2, "a", "A", None, None)]


def test_nearest_equals_brute_force_everywhere(spark):
    rng = random.Random(5)
    def point():
        return rng.choice([(rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.uniform(88, 90), rng.uniform(-180, 180)),
                           (rng.uniform(-2, 2), rng.choice([-1, 1]) * rng.uniform(178, 180)), (rng.gauss(45.5, 0.3), rng.gauss(-73.6, 0.3))])
    places = [(i, *point()) for i in range(80)]
    sites = [(f"f{i:03d}", *point()) for i in range(400)]
    def km(a, b):
        p1, p2 = math.radians(a[1]), math.radians(b[1])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((math.radians(b[2]) - math.radians(a[2])) / 2) ** 2
        return 2 * EARTH_KM * math.asin(min(1, math.sqrt(h)))
    df = spark.createDataFrame(places, "place_id int, lat double, lon double")
    fac = spark.createDataFrame([*[(f, str(a), str(b)) for f, a, b in sites], ("none", "", "")], "facility_id string, latitude string, longitude string")
    for radius in (25.0, 400.0):
        got = {}
        for r in nearest(df, fac, 3, radius).orderBy("place_id", "rank").collect():
            got.setdefault(r.place_id, []).append(r.facility_id)
        want = {p[0]: [f for d, f in sorted((km(p, s), s[0]) for s in sites) if d <= radius][:3] for p in places}
        assert got == {k: v for k, v in want.items() if v}


def test_cells_list_the_nearest_of_all_their_places(spark, monkeypatch):
    """Places of a cell go down the pyramid as one box; the lists hold the nearest of each, in parts too and at every level."""
    from signpost.operators import nearest as module

    def km(p, q):
        (a, b), (c, d) = ([math.radians(x) for x in xy] for xy in (p, q))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * EARTH_KM * math.asin(min(1, math.sqrt(h)))

    rng = random.Random(17)
    centres = [(45.5, -73.6), (89.9, 10.0), (-12.0, 180.0)]
    spot = lambda: (max(-90.0, min(90.0, rng.choice(centres)[0] + rng.gauss(0, 0.2))), rng.choice(centres)[1] + rng.gauss(0, 0.2))
    places = [(i, rng.choice("ab"), *spot()) for i in range(300)] + [(1000, "a", None, 10.0), (1001, "b", float("nan"), 1.0)]
    facilities = [(i, rng.choice("ab"), *(str(x) for x in spot())) for i in range(400)] + [(900, "a", "", "x")]
    df = spark.createDataFrame(places, "place_id int, kind string, lat double, lon double")
    fac = spark.createDataFrame(facilities, "facility_id int, kind string, latitude string, longitude string")
    levels = set()
    for shared, points in ((4, 4096), (10_000, 7), (0, 4096)):
        monkeypatch.setattr(module, "SHARED", shared)
        monkeypatch.setattr(module, "POINTS", points)
        listed, level = module.around(df, fac, 3, 60.0, by=["kind"])
        levels.add(level)
        held, boxes = {}, listed.collect()
        for r in boxes:
            held.setdefault((r.kind, r.cell), []).extend((p.latitude, p.longitude, p.facility_id) for p in r.points)
        assert len(boxes) >= len(held) and all(len(h) == len(set(h)) for h in held.values())
        for r in df.withColumn("cell", module.cell_of(F.col("lat"), F.col("lon"), 60.0, level)).collect():
            assert (r.cell is None) == (r.place_id >= 1000)
            if r.cell is not None:
                best = lambda rows: sorted(x for x in ((km((r.lat, r.lon), (a, b)), i) for a, b, i in rows) if x[0] <= 60)[:3]
                assert best(held.get((r.kind, r.cell), [])) == best([(float(a), float(b), i) for i, k, a, b in facilities if k == r.kind and a])
    assert len(levels) == 3


def test_only_cells_of_places_are_shuffled(spark, monkeypatch):
    """Ten times the places in the same cells hand on no more rows to the steps down the pyramid."""
    from signpost.operators import nearest as module

    rng = random.Random(5)
    fac = spark.createDataFrame([(i, 45 + rng.random() / 5, -73 + rng.random() / 5) for i in range(200)], "facility_id int, latitude double, longitude double")
    rows, kept = {}, []
    monkeypatch.setattr(module, "written", lambda df, name: kept.append((name, df)) or df)
    for times in (1, 10):
        kept.clear()
        spots = [(45 + (i % 20) / 100 + rng.random() / 1e4, -73 + (i % 13) / 100 + rng.random() / 1e4) for i in range(260 * times)]
        listed, _ = module.around(spark.createDataFrame(spots, "lat double, lon double"), fac, 3, 30.0)
        rows[times] = dict(kept)["cells"].count(), listed.count()
    assert rows[10][0] <= 4 * rows[1][0] and rows[10][0] < 2600 / 2


def test_nearest_forms_few_pairs_among_many_at_one_point(spark, monkeypatch):
    """A third of the facilities stand at one point, the places beside the others and far from all."""
    from signpost.operators import nearest as module

    rng = random.Random(6)
    sites = [(f"f{i:04d}", "a" if i % 3 else "b", 45.5, -73.6) for i in range(1_000)]
    sites += [(f"g{i:04d}", "a" if i % 3 else "b", 45.5 + rng.gauss(0, 0.2), -73.6 + rng.gauss(0, 0.2)) for i in range(2_000)]
    places = [(i, "ab"[i % 2], 45.5 + rng.uniform(-0.6, 0.6), -73.6 + rng.uniform(-1.2, 0.1)) for i in range(300)] + [(900, "a", 45.5, -73.6), (901, "a", None, 1.0)]
    met = []
    top = module.top_per_key
    monkeypatch.setattr(module, "top_per_key", lambda df, *how, **more: (more and met.append(df.count())) or top(df, *how, **more))
    df = spark.createDataFrame(places, "place_id int, kind string, lat double, lon double")
    fac = spark.createDataFrame([(f, kind, str(a), str(b)) for f, kind, a, b in sites], "facility_id string, kind string, latitude string, longitude string")
    got = {}
    for r in nearest(df, fac, 3, 60.0, by=["kind"]).orderBy("place_id", "rank").collect():
        got.setdefault(r.place_id, []).append(r.facility_id)
    def km(a, b):
        p1, p2 = math.radians(a[2]), math.radians(b[2])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((math.radians(b[3]) - math.radians(a[3])) / 2) ** 2
        return 2 * EARTH_KM * math.asin(min(1, math.sqrt(h)))
    want = {p[0]: [f for d, f in sorted((km(p, s), s[0]) for s in sites if s[1] == p[1]) if d <= 60][:3] for p in places[:-1]}
    assert got == {p: f for p, f in want.items() if f} and got[900] == ["f0001", "f0002", "f0004"]
    assert met and met[-1] <= 10 * 3 * len(places)


def test_reports_cover_every_rule(spark):
    guidance = spark.createDataFrame([("g1", "housing", "", "https://x.ca", True), ("g1", "housing", "t", "", False)],
                                     "record_id string, category string, linked_resource_url string, source_page_url string, deep_parsed boolean")
    fac = spark.createDataFrame([("f1", "1", "", "2"), ("f1", "2466023.0", "1", "2")], "facility_id string, csd_uid string, latitude string, longitude string")
    manifest = spark.createDataFrame([("u", "offline"), ("v", "")], "url string, error string")
    rules = {r.rule for r in reports.guidance_violations(guidance, fac, manifest).collect()}
    assert rules == {"guidance_category_mismatch", "guidance_id_repeated", "guidance_source_missing", "page_not_allowlisted",
                     "facility_id_repeated", "facility_outside_city", "coordinates_missing", "fetch_failed"}
    cand = spark.createDataFrame([("c", "s", "", "n"), ("c", "z", "u", "n")], "record_id string, source_id string, source_url string, service_name string")
    allowed = spark.createDataFrame([("s",)], "source_id string")
    assert {r.rule for r in reports.navigator_violations(cand, allowed).collect()} == {"candidate_id_repeated", "candidate_field_missing", "source_not_structured"}
    samples = spark.createDataFrame([("a", True, 60, "heading", ""), ("b", False, 0, "", "offline"), ("c", False, 0, "", "")],
                                    "source_id string, parseable boolean, parsed_sample_chars int, sample_type string, error string")
    assert {(r.key, r.detail) for r in reports.sample_violations(samples).collect()} == {("b", "offline"), ("c", "No parseable content found.")}
    metrics = {(r.section, r.key): r.value for r in reports.sample_metrics(samples).collect()}
    assert metrics["parse_samples", "failed"] == 2 and metrics["parse_samples", "min_chars"] == 60 and metrics["sample_type", ""] == 2
    assert Q.missing_values(samples, ["error"], "m").collect()[0].value == 2
