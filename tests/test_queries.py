"""Every registered query against its SQL on the smallest benchmark tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
ROOT = Path(__file__).resolve().parents[1]
FOLDER = os.environ.get("SIGNPOST_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables")

sys.path.insert(0, str(ROOT))
import __spark_entry__ as contract  # noqa: E402


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def comparable(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


# The training-data queries have their own tests beside them.
NAMES = sorted(set(contract.queries()) - set(contract.LLM_QUERIES))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    cursor = tables.execute(contract.oracle_sql()[name])
    position = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(position) == columns
    want = [tuple(r[position[c]] for c in columns) for r in cursor.fetchall()]
    assert comparable(got) == comparable(want)


def test_workers_need_no_installed_package(tmp_path):
    """The page reader travels with the job: run from elsewhere, without the repository on PYTHONPATH."""
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from signpost.session import session\n"
        "from signpost.operators.pages import parse_pages\n"
        "s = session('w', 'local[2]', **{'spark.ui.enabled': 'false'})\n"
        "df = s.createDataFrame([(1, '<p>a')], 'id int, html string')\n"
        "print('TEXT', parse_pages(df, ['id'], base=None).collect()[0].text)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "TEXT a" in out.stdout, out.stderr[-2000:]
