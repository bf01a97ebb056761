"""Evaluate trials as they arrive: each is evaluated once, and a batch that is repeated adds nothing twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veridex.operators.judging import still_to_do
from veridex.sources.readers import exists

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def evaluate_stream(trials: DataFrame, evaluate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "nct_id") -> StreamingQuery:
    """Runs until the stream's present input is used up.

    Keys that have come before are in the stream's state (on disk, dealt by key), so no old input or result is read again.
    Only the first batch of a new checkpoint is held against what ``out`` has from elsewhere. Each batch has a partition
    ``batch`` of ``out`` below the checkpoint's name, which it replaces when it is repeated."""
    spark = trials.sparkSession
    source = checkpoint.rstrip("/").rpartition("/")[2]

    def batch(rows: DataFrame, number: int) -> None:
        if number == 0 and exists(rows.sparkSession, out):
            done = rows.sparkSession.read.parquet(out).filter(f"source <> '{source}'")
            rows = still_to_do(rows, done, key)
        found = evaluate(rows).selectExpr("*", f"'{source}' AS source", f"{number} AS batch")
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "batch").parquet(out)

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return trials.dropDuplicates([key]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE, before)
