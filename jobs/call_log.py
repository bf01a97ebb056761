"""Daily statistics of a growing call log.

    python -m jobs.call_log --log DIR --output DIR --checkpoint DIR [--config FILE]

The log is a folder of Parquet files to which new ones are added, or a pattern of files such as ``calls.parquet*`` (``ts, event_type, value``: when, which kind of call, how many
seconds it took; calls of the kind ``failed`` are failures). A run takes the files that no run has taken yet, and ends.

Each batch of files writes how many calls of a day and kind took so long to ``<output>/counts``, a partition for each day and
batch, and then the days that it has calls of anew to ``<output>/days``, from the counts of all batches. So a late call of an
old day is no special case, old log files are never read again, and a batch that is repeated after a failure replaces its
own partitions by the same rows. The checkpoint remembers the files; the counts go with it, so an output has one checkpoint.

A call without a time is of no day, and counts as one of the null day. A row that is in two files is two calls.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, observed
from veridex.operators import latency

LOG = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"
COUNTS = "event_type STRING, step LONG, calls LONG, failures LONG, day STRING, batch LONG"
DAYS = "event_type STRING, n_calls LONG, n_failed LONG, total LONG, least LONG, most LONG, p50 LONG, p95 LONG, day STRING"
NO_DAY = "none"


def replaced(rows: DataFrame, path: str, *by: str) -> None:
    """Writes partitions; those that have no rows here stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def taken(calls: DataFrame, batch: int, output: str, settings: dict) -> None:
    """One batch of the log: its counts, then its days anew."""
    spark, read, wrote = calls.sparkSession, Observation(), Observation()
    calls = calls.observe(read, F.count(F.lit(1)).alias("n")).withColumn("day", F.coalesce(F.to_date("ts").cast("string"), F.lit(NO_DAY)))
    counts = latency.counted(calls, ("day", "event_type"), "value", F.col("event_type") == settings["failed"], settings["per_second"])
    replaced(counts.withColumn("batch", F.lit(batch).cast("long")), f"{output}/counts", "day", "batch")
    every = spark.read.schema(COUNTS).parquet(f"{output}/counts")
    days = every.filter(F.col("batch") == batch).select("day").distinct()
    found = latency.statistics(every.join(days, "day", "left_semi"), ("day", "event_type"))
    replaced(found.select(*names(DAYS)).observe(wrote, F.count(F.lit(1)).alias("n")), f"{output}/days", "day")
    log.info("batch %d: read %d calls, wrote %d rows to %s/days", batch, observed(read), observed(wrote), output)


def names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def run(spark: SparkSession, log: str, output: str, checkpoint: str, settings: dict) -> dict:
    """Brings the daily statistics of a call log up to date with its new files."""
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", settings["files_at_once"]).parquet(log)
    query = stream.writeStream.foreachBatch(lambda rows, batch: taken(rows, batch, output, settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return {"batches": sum(p["numInputRows"] > 0 for p in query.recentProgress), "rows": sum(p["numInputRows"] for p in query.recentProgress)}


def read_back(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(DAYS).parquet(f"{output}/days").withColumn("day", F.nullif("day", F.lit(NO_DAY)))


if __name__ == "__main__":
    sys.exit(main("call_log", "call_log.json", {"log": "folder of the log's Parquet files", "output": "folder of counts and days", "checkpoint": "folder of the stream's checkpoint"}, run))
