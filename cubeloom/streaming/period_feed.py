"""Period replacement as a stream: arriving rows replace their periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.layout import write_periods


def replace_periods(rows: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Run what has arrived and stop. ``rows`` streams whole periods per batch.

    A batch that is run again after a failure overwrites the same periods and
    repeats their manifest entries, so the result is as if it had run once.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        write_periods(batch, root)

    return (
        rows.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_files(spark: SparkSession, folder: str, like: DataFrame, pattern: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)
