"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line.

Each query is timed from building it (jobs that count or cut a side included) to its last row. The tables
come as one file of one row group each, which one task alone can read; so they are first copied, untimed,
into files of many row groups, as large tables are stored. ``BENCH_COPY=0`` reads them as they are.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parent))

from signpost.queries import load  # noqa: E402
from signpost.session import session  # noqa: E402

HEADLINE = (
    "rank_services_top3", "rank_free_text_needs", "precedence_ranking", "scenario_eval",
    "record_ids", "clean_text", "dedupe_last", "dedupe_first_casefold", "cap_per_source",
    "page_nodes", "page_candidates", "page_manifest", "parse_samples", "useful_records",
    "guidance_catalogue", "partner_directory", "violations", "missingness", "sensitive_scan",
    "nearest_facilities",
)


def copied(folder: str, to: Path, cpus: int) -> str:
    """The tables under ``to``, in as many files of equal rows as there are cores."""
    for file in Path(folder).glob("*.parquet"):
        rows = pq.read_table(file)
        each = max(1, -(-rows.num_rows // cpus))
        (to / file.name).mkdir(parents=True)
        for n, at in enumerate(range(0, max(rows.num_rows, 1), each)):
            pq.write_table(rows.slice(at, each), to / file.name / f"part-{n:03d}.parquet", row_group_size=max(1_000, each // 4))
    return str(to)


def main() -> None:
    made = tempfile.TemporaryDirectory(prefix="bench-", ignore_cleanup_errors=True)
    scratch = Path(made.name)
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "signpost-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": (scratch / "shared").as_uri(),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    names = sys.argv[1:] or HEADLINE
    # Untimed: starts the JVM's threads, Python workers and compiler on the smallest tables at hand.
    small = str(Path(folder).parent / "sf0.001")
    for name in ("rank_services_top3", "page_candidates"):
        queries[name](spark, small if Path(small).is_dir() else folder).write.format("noop").mode("overwrite").save()
    seconds, given = {}, folder
    if os.environ.get("BENCH_COPY", "1") != "0":
        folder = copied(folder, scratch / "tables", int(cpus))
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": given.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()
    made.cleanup()


if __name__ == "__main__":
    main()
