"""Session defaults and the few helpers that look at the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "signpost", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library relies on; cluster sizing stays with the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Parsed pages are wide rows, so Arrow batches stay short.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session may do without; it gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; it goes when the driver ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


#: Whether the shuffle files of a query go as it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of the rows that go to a Python worker at once; 10 000 texts, as without it, are tens of MB in several copies,
#: outside the heap of the executor and in the worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
WRITING = {CLEANUP: "true", BATCH_BYTES: "1m"}


def set_unless_set(spark: SparkSession, conf: dict[str, str]) -> list[str]:
    """Settings of the session that it does not have already, and their names."""
    new = [key for key in conf if spark.conf.get(key, None) is None]
    for key in new:
        spark.conf.set(key, conf[key])
    return new


def written(df: DataFrame, name: str) -> DataFrame:
    """Compute once: write the rows as Parquet into the shared folder and read them back.

    The table outlives lost executors, and later stages read only the columns they use. Its
    folder goes when the driver ends, the shuffle files of making it as soon as it is written.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    new = set_unless_set(spark, WRITING)
    try:
        df.write.parquet(folder)
    finally:
        for key in new:
            spark.conf.unset(key)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Remove what :func:`written` wrote, once nothing will read it any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
