import json

import pytest
from pyspark.sql import functions as F

from signpost import schemas as S
from signpost import vocabulary as V
from signpost.plans import facilities as FAC
from signpost.sinks import files as K
from signpost.sources import files as R

HEADER = "record_id,service_name,category_id,category_label,student_need,official_source_url,extra\n"


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))
    return str(path)


def test_service_records_are_split_into_valid_and_rejected(spark, tmp_path):
    path = write(tmp_path / "d.csv", "﻿" + HEADER + 'a,"Hub, ""main""\nline 2",tax,Tax,NA,https://a.ca,x\nb,B,tax,Tax,n,,x\nc,null,tax,Tax,n,nope,x\n')
    valid, rejected = R.read_service_records(spark, path)
    assert valid.columns == list(S.SERVICE_RECORD_FIELDS)
    rows = {r.record_id: r for r in valid.collect()}
    assert list(rows) == ["a"]
    assert rows["a"].service_name == 'Hub, "main"\nline 2' and rows["a"].student_need == "" and rows["a"].limitations is None
    bad = {r.record_id: (r.service_name, r.rejected_because) for r in rejected.collect()}
    assert bad == {"b": ("B", "invalid:official_source_url"), "c": ("", "invalid:official_source_url")}


def test_absent_optional_url_is_valid_and_absent_required_is_not(spark, tmp_path):
    valid, rejected = R.read_service_records(spark, write(tmp_path / "d.csv", "record_id,service_name,category_id\na,A,tax\n"))
    assert valid.count() == 0
    assert [r.rejected_because for r in rejected.collect()] == ["missing:category_label"]


def test_csv_round_trip_drops_or_refuses_unknown_columns(spark, tmp_path):
    df = spark.createDataFrame([("x", True, None, ["p", "q"], 3, 'a "b"\nc')], "a string, b boolean, c string, d array<string>, e int, f string").withColumn("g", F.to_timestamp(F.lit("2026-06-12 01:02:03")))
    fields = ("f", "a", "b", "c", "d", "e", "g")
    K.write_csv(df.withColumn("extra", F.lit(1)), str(tmp_path / "out"), fields)
    back = R.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == list(fields)
    assert tuple(back.collect()[0]) == ('a "b"\nc', "x", "true", "", "p | q", "3", "2026-06-12T01:02:03+00:00")
    with pytest.raises(ValueError):
        K.write_csv(df.withColumn("extra", F.lit(1)), str(tmp_path / "no"), fields, strict=True)
    with pytest.raises(ValueError):
        K.interchange(df, (*fields, "absent"))


def test_json_is_unescaped_and_arrays_read_back(spark, tmp_path):
    K.write_json(spark.createDataFrame([("é", None)], "a string, b string"), str(tmp_path / "j"), ("a", "b"))
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "j").glob("*.json"))
    assert '"é"' in text and json.loads(text) == {"a": "é", "b": ""}
    path = write(tmp_path / "array.json", json.dumps([{"a": "1", "z": 2}, {"a": "2", "b": "x"}], indent=2))
    assert sorted(tuple(r) for r in R.read_json_array(spark, path, ("a", "b")).collect()) == [("1", ""), ("2", "x")]


def test_json_lines_round_trip_over_many_rows_and_files(spark, tmp_path):
    df = spark.range(500).select(F.col("id").cast("string").alias("a"), F.concat(F.lit("line\nbreak é "), "id").alias("b")).repartition(4)
    K.write_json(df, str(tmp_path / "lines"), ("a", "b"))
    back = R.read_json_lines(spark, str(tmp_path / "lines"), ("a", "b"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_csv_without_line_breaks_splits_and_reads_alike(spark, tmp_path):
    df = spark.range(300).select(F.concat(F.lit("r"), "id").alias("service_id"), *[F.lit("x").alias(f) for f in S.SERVICE_SPEC_FIELDS[1:]]).repartition(3)
    K.write_csv(df, str(tmp_path / "specs"), S.SERVICE_SPEC_FIELDS)
    for multi_line in (True, False):
        back = R.read_service_specs(spark, str(tmp_path / "specs"), multi_line=multi_line)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_windows_1252_facility_file(spark, tmp_path):
    head = ",".join(S.FACILITY_SOURCE_FIELDS)
    row = "{i},  Clinique “É”\t{i} ,t,Hospitals,p,,1,Rue,,Montréal,{p},,Montréal,{code},24,45.5,-73.5"
    body = "\n".join([head, row.format(i=2, p="qc", code="2466023.0"), row.format(i=1, p="QC", code="2466023.0"),
                      row.format(i=3, p="Qc", code="2466023"), row.format(i=4, p="on", code="35")])
    source = R.read_csv(spark, write(tmp_path / "f.csv", body.encode("cp1252")), S.text_schema(S.FACILITY_SOURCE_FIELDS), "cp1252")
    first = FAC.facilities(source, F.lit("2026-06-12").cast("timestamp")).orderBy(*FAC.facility_order()).collect()
    later = FAC.facilities(source, F.lit("2026-07-01").cast("timestamp")).orderBy(*FAC.facility_order()).collect()
    assert [r.facility_id for r in first] == ["odhf-1", "odhf-2"] and first[0].facility_name == "Clinique “É” 1"
    assert tuple(FAC.facilities(source, F.current_timestamp()).columns) == S.FACILITY_FIELDS
    assert [r.record_content_hash for r in first] == [r.record_content_hash for r in later]
    assert tuple(FAC.nested_counts(source).collect()[0]) == (4, 3, 2)


def test_registry_reads_the_flag_under_its_own_name(spark, tmp_path):
    fields = [f if f != "own_organisation" else "ours" for f in S.REGISTRY_FIELDS]
    path = write(tmp_path / "r.csv", ",".join(fields) + "\ns,O,https://a.ca,c,general,True,approved,structured_html,m,why\n")
    df = R.read_registry(spark, path, own_flag="ours")
    assert df.columns == list(S.REGISTRY_FIELDS) and df.collect()[0].own_organisation is True
    specs = write(tmp_path / "s.csv", ",".join(S.SERVICE_SPEC_FIELDS) + "\n" + ",".join("abcdefghi") + "\n")
    assert R.read_service_specs(spark, specs).columns == list(S.SERVICE_SPEC_FIELDS)


def test_vocabularies(spark):
    assert R.taxonomy(spark).count() == 12 and R.agencies(spark).count() == len(V.AGENCIES)
    assert R.section_categories(spark).count() == 6 and R.detail_pages(spark).count() == 9
    assert set(V.HIGH_RISK_CATEGORIES) <= {c for c, _ in V.TAXONOMY}
    assert V.skip_titles("Example")[-1] == "Make a gift to Example" and V.boilerplate_fragments("Example")[0] == "example university"


def test_run_fails_on_violations(spark):
    empty = spark.createDataFrame([], "rule string, key string, detail string")
    K.require_clean(empty)
    with pytest.raises(SystemExit):
        K.require_clean(spark.createDataFrame([("r", "k", "d")], empty.schema))


def test_sorted_sink(spark, tmp_path):
    K.write_sorted(spark.range(50).orderBy(F.rand(1)), str(tmp_path / "s"), ["id"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 50


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_split_csv_equals_the_reader_of_whole_files(spark, tmp_path, newline):
    import csv
    import random
    draw = random.Random(5)
    cell = lambda: "".join(draw.choice(['a', 'é', ' ', ',', '"', newline, 'x y', newline + newline]) for _ in range(draw.choice([0, 1, 3, 40])))
    for name in ("one", "two"):
        with open(tmp_path / f"{name}.csv", "w", encoding="utf-8-sig", newline="") as out:
            rows = csv.writer(out, lineterminator=newline)
            rows.writerow(["id", "text, a", "b"])
            for i in range(400):
                rows.writerow([f"{name}{i}", cell(), cell()])
            # A record longer than several blocks, and empty lines between records.
            rows.writerow([f"{name}long", ("line" + newline) * 2000, "end"])
            out.write(newline)
            rows.writerow([f"{name}last", "", 'q"'])
    whole = sorted(map(tuple, R.read_csv(spark, str(tmp_path), whole_files=True).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "3000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            split = R.read_csv(spark, str(tmp_path), position="at")
            assert sorted(tuple(r)[1:] for r in split.collect()) == whole and len(whole) == 804
            ids = [r.id for r in split.orderBy("at").collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert ids == [f"{n}{i}" for n in ("one", "two") for i in (*range(400), "long", "last")]


def test_csv_files_of_unlike_headers_are_refused(spark, tmp_path):
    write(tmp_path / "1.csv", "a,b\n1,2\n")
    write(tmp_path / "2.csv", "a,c\n1,2\n")
    with pytest.raises(Exception, match="another header"):
        R.read_csv(spark, str(tmp_path)).collect()
