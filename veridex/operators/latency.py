"""Counts of calls by their latency: exact, mergeable, and small whatever the number of calls.

A latency is counted in whole steps (hundredths of a second by default). Tables of counts of parts of a log add up to that
of the whole log, so that a run that goes on needs no old call again; a percentile is read from the sums, by nearest rank:
the smallest latency that at least that share of the calls doesn't exceed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(seconds: Column, per_second: int = 100) -> Column:
    """A latency in whole steps; null stays null, and below zero it counts as zero."""
    return F.greatest(F.round(seconds * per_second), F.lit(0)).cast("long")


def counted(calls: DataFrame, keys: Sequence[str], latency: str, failed: Column, per_second: int = 100) -> DataFrame:
    """``keys, step, calls, failures``: how many calls of a key took so long. A call without a latency has a null step."""
    rows = calls.select(*keys, steps(F.col(latency), per_second).alias("step"), F.coalesce(failed, F.lit(False)).cast("long").alias("failed"))
    return rows.groupBy(*keys, "step").agg(F.count("*").alias("calls"), F.sum("failed").alias("failures"))


def merged(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tables of counts, put together, as one."""
    return counts.groupBy(*keys, "step").agg(F.sum("calls").alias("calls"), F.sum("failures").alias("failures"))


def statistics(counts: DataFrame, keys: Sequence[str], percents: Sequence[int] = (50, 95)) -> DataFrame:
    """One row a key: ``n_calls, n_failed``, the sum, the least and the largest of the steps, and ``p50, p95``; of steps all
    are null where no call has one. A key's window sorts its distinct steps, not its calls."""
    keys = list(keys)
    each = merged(counts, keys)
    known = F.when(F.col("step").isNotNull(), F.col("calls")).otherwise(0)
    upto = each.withColumn("upto", F.sum(known).over(Window.partitionBy(*keys).orderBy("step"))).withColumn("of", F.sum(known).over(Window.partitionBy(*keys)))
    # in whole numbers: upto / of >= percent / 100
    at = [F.min(F.when(F.col("step").isNotNull() & (F.col("upto") * 100 >= F.col("of") * p), F.col("step"))).alias(f"p{p}") for p in percents]
    return upto.groupBy(*keys).agg(F.sum("calls").alias("n_calls"), F.sum("failures").alias("n_failed"), F.sum(F.col("step") * F.col("calls")).alias("total"), F.min("step").alias("least"), F.max("step").alias("most"), *at)
