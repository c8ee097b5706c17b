"""The pipeline's stages by their contract, and every registered query that SQL can state against its SQL."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from signpost.llm.queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("SIGNPOST_TEST_TABLES", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables")


@needs_tables
def test_stages_hand_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        assert rows, name
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            assert {r.doc_id for r in rows} <= set(before)
        if name in ("language", "near_dedup"):
            assert len(rows) == len({r.doc_id for r in rows}) and all(r.text == before[r.doc_id] for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "passage_dedup", "mix", "pack"]
    held = Counter()
    for r in rows:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048


@needs_tables
def test_run_equals_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / f"r{k}"))
        docs = spark.read.parquet(str(tmp_path / f"r{k}"))
    pieces = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(docs) == pieces(corpus_pipeline.run(spark, FOLDER))


def test_every_operator_has_a_query():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    cursor = con.execute(SQL[name])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    assert sorted(at) == columns
    want = sorted(repr(tuple(r[at[c]] for c in columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


@needs_tables
def test_workers_need_no_installed_package(tmp_path):
    """What tasks run travels with the job: run from elsewhere, without the repository on PYTHONPATH."""
    root = str(Path(__file__).resolve().parents[2])
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from signpost.session import session\n"
        "s = session('w', 'local[2]', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'})\n"
        "from signpost.llm.queries import QUERIES\n"
        "for name in ('op1_suffix', 'op3_simhash', 'op4_language', 'op5_neighbours', 'op7_packing', 'op9_passages', 'op10_clusters', 'op11_ranking', 'op13_negatives'):\n"
        f"    print('DONE', name, QUERIES[name](s, {FOLDER!r}).count() >= 0)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.stdout.count("DONE") == 9, out.stderr[-2000:]


def test_long_texts_go_to_python_in_batches_of_few_bytes(spark):
    from signpost.llm.common import map_arrow, written
    from signpost.session import BATCH_BYTES

    docs = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 20000) AS text", "'en' AS lang")

    def sizes(batch):
        yield [[batch.num_rows]]

    batches = [r.n for r in written(map_arrow(docs, lambda: sizes, "n long"), "sizes").collect()]
    assert sum(batches) == 60 and max(batches) <= 12
    assert spark.conf.get(BATCH_BYTES, None) is None
    try:
        corpus_pipeline.identify(spark, docs, "")
        assert spark.conf.get(BATCH_BYTES) == "1m"
    finally:
        spark.conf.unset(BATCH_BYTES)
