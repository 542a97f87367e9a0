"""Ledger posting as a stream: each charge key is posted once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass
class Posting:
    """The two streams of a ledger: rows with a charge key, and rows without one."""

    keyed: StreamingQuery
    unkeyed: StreamingQuery

    def awaitTermination(self) -> None:  # noqa: N802  as StreamingQuery has it
        self.keyed.awaitTermination()
        self.unkeyed.awaitTermination()


def post_charges(charges: DataFrame, path: str, checkpoint: str) -> Posting:
    """Run what has arrived and stop; the first row of each key is posted, however late a retry comes.

    The first row is that of the earliest batch, in it the one with the smallest
    ``ts``. It is kept in keyed state: a streaming minimum per key, summed up in
    part before the shuffle, whose store reads a batch's own keys only. A key is
    new when its first batch is the batch at hand. State does not expire, as a
    retry may come at any time. Rows without a key are shared with nobody; each
    is posted, and none is kept.

    Posted rows lie below ``path`` in one directory for each batch and are never read
    again. A batch that runs again starts from the same state and overwrites its
    directory, so a failure between write and commit posts nothing twice.
    """
    rest = [c for c in charges.columns if c != "charge_key"]
    # the time of the batch, which a batch that runs again has as well
    timed = charges.where("charge_key is not null").withColumn("batch_time", F.current_timestamp())
    seen = timed.groupBy("charge_key").agg(
        F.min(F.struct("batch_time", "ts", F.struct(*rest).alias("row"))).alias("first"), F.max("batch_time").alias("latest")
    )
    new = seen.where("first.batch_time = latest").select("charge_key", "first.row.*")
    spark = charges.sparkSession
    return Posting(
        _started(spark, new, path, "", f"{checkpoint}/keyed", "update"),
        _started(spark, charges.where("charge_key is null").select("charge_key", *rest), path, "-unkeyed", f"{checkpoint}/unkeyed", "append"),
    )


def _started(spark: SparkSession, rows: DataFrame, path: str, suffix: str, checkpoint: str, mode: str) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(_write_to(path, suffix)).outputMode(mode).option("checkpointLocation", checkpoint)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)  # a query keeps the settings it was started with
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def _write_to(path: str, suffix: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/batch={batch_id}{suffix}")

    return write
