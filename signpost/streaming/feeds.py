"""Streams of intakes, fetched pages and fetches through the batch plans.

Ranking and extraction are stateless per input row, so no watermark or state store is involved. Ranking
needs the distinct needs of its input and therefore runs per micro-batch. The latest row per key is
kept in state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from signpost.operators.matching import rank_records, with_explanation
from signpost.operators.ordering import last_per_key
from signpost.plans import navigator


def read_feed(spark: SparkSession, path: str, schema: StructType, format: str = "parquet", **options) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(format).options(**options).load(path)


def _each_batch(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write ``build(batch)`` under a folder named by the batch, so a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the plan reads its input more than once
        try:
            build(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def rank_intakes(intakes: DataFrame, records: DataFrame, path: str, checkpoint: str, limit: int = 3) -> StreamingQuery:
    """Ranked, explained recommendations for every intake that has arrived."""
    return _each_batch(
        intakes, lambda batch: with_explanation(rank_records(batch, records, limit)), path, checkpoint)


def extract_pages(sources: DataFrame, path: str, checkpoint: str, organisation: str = "") -> StreamingQuery:
    """Page facts and candidate items of every fetched source page (no shuffle, so a plain append).

    ``sources`` has ``navigator.SOURCE_COLUMNS`` and ``html``. Candidates and manifest are read from
    the result.
    """
    return (
        navigator.extract_items(sources, navigator.SOURCE_COLUMNS, organisation).writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def keep_last(stream: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """The last row per key over all that has arrived, in the order of ``order`` and not of arrival.

    Each key's row is state; a micro-batch writes the rows of the keys it touched, under a folder
    named by the batch. Rows that come late or again change nothing. ``order`` should tell any two
    unlike rows of a key apart. Read the table with :func:`last_rows`.
    """
    row = F.max_by(F.struct(*stream.columns), F.struct(*order))
    return (
        stream.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(row.alias("_row")).select("_row.*")
        .writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))
        .start()
    )


def last_rows(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table that :func:`keep_last` has reached; a key's row is the last one written for it."""
    return last_per_key(spark.read.parquet(path).drop("batch_id"), keys, order)
