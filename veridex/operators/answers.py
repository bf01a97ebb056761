"""Answers of judges, kept as they come: a call that fails costs that call alone, and no answered call is made again.

Calls are asked in chunks, each a Spark job that ends with its answers in a partition of its own; what is written stays,
whatever comes later. A few chunks are asked at a time, so that cores don't wait while one is planned, ends or is written;
together they have the tasks of one. A call that fails for good is a row, too, with its ``error``: the others of its task go
on, so that Spark has no reason to repeat a task. A later run asks for the calls without an answer. Only where Spark loses an
executor are calls made again: those of its tasks in the chunks that are being asked, at most ``CHUNKS_ASKED`` times
``at_once`` calls.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.operators import scoring
from veridex.operators.judging import Judge, judged, settled, still_to_do, verdicts
from veridex.schemas import RESULT
from veridex.sources import readers

#: Calls of a chunk, and chunks that are asked at a time.
AT_ONCE, CHUNKS_ASKED = 50_000, 4


def kept(spark: SparkSession, path: str, keys: dict[str, str], side: str | None = None) -> DataFrame:
    """``keys`` (name and type), ``answer, side, chunk`` of all answers and failures at ``path`` so far."""
    schema = ", ".join(f"`{k}` {kind}" for k, kind in keys.items()) + f", answer {RESULT}, side STRING, chunk STRING"
    rows = spark.read.schema(schema).parquet(path) if readers.exists(spark, path) else spark.createDataFrame([], schema)
    return rows if side is None else rows.filter(F.col("side") == side)


def answered(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("answer.error").isNull())


def asked(
    calls: DataFrame, judge: Judge, path: str, side: str, keys: Sequence[str], profile: str = "profile", text: str = "text", at_once: int = AT_ONCE, tasks: int | None = None, give_up: int = 20, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """Asks for each of ``calls`` that ``path`` has no answer of this ``side`` to, and returns what it has then (``kept``).

    Calls with equal ``keys`` are one call. ``tasks`` ask side by side (by default as many as the cluster has cores), dealt to
    the chunks that are asked at a time; one that fails ``give_up`` times in a row asks no more, and its other calls are failures that were never made."""
    spark, kinds = calls.sparkSession, {k: calls.schema[k].dataType.simpleString() for k in keys}
    judge.ready()
    todo = still_to_do(calls.select(*keys, profile, text).dropDuplicates(list(keys)), answered(kept(spark, path, kinds, side)), keys)
    chunks = -(-todo.count() // at_once)
    run = uuid.uuid4().hex[:12]
    if not chunks:
        return kept(spark, path, kinds, side)
    # one file a chunk: else each task would write one for each chunk
    todo = readers.scratch(todo.withColumn("chunk", F.pmod(F.xxhash64(*keys), F.lit(chunks))).repartition("chunk"), "calls", "chunk")
    tasks = tasks or spark.sparkContext.defaultParallelism
    asides = min(CHUNKS_ASKED, chunks, tasks)

    def ask(k: int) -> None:
        some = todo.filter(F.col("chunk") == k).drop("chunk").repartition(tasks // asides, *keys)
        judged(some, judge, profile, text, "answer", sleep, give_up).select(*keys, "answer").write.parquet(f"{path}/side={side}/chunk={run}-{k}")

    with ThreadPoolExecutor(asides) as pool:
        asks = [pool.submit(inheritable_thread_target(spark)(ask), k) for k in range(chunks)]
        try:
            for one in as_completed(asks):
                one.result()
        finally:  # where one breaks off, those that are being asked end and are kept, and no other begins
            for one in asks:
                one.cancel()
    return kept(spark, path, kinds, side)


def failures(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, error``: the last-known failure of each call that has no answer."""
    return still_to_do(rows.groupBy(*keys).agg(F.max("answer.error").alias("error")), answered(rows), keys)


def evaluate(pairs: DataFrame, criteria: DataFrame, profiles: DataFrame, judge: Judge, second: Judge | None, path: str, keys: Sequence[str] = ("patient_id", "nct_id"), **how) -> tuple[DataFrame, DataFrame]:
    """Verdicts of every criterion of the pairs of patient and trial that are answered in full, and the calls that failed.

    ``criteria`` has ``nct_id, pos, kind, idx, text, features``, ``profiles`` ``patient_id, profile``. Answers go to ``path``; the
    second judge is asked for verdicts in the band alone. The second table has ``keys, pos, kind, idx, side, error``: the pairs
    in it have no verdicts yet. ``how`` goes to ``asked``."""
    if second is not None:
        second.ready()
    each = [*keys, "pos"]
    rows = readers.scratch(pairs.select(*keys).join(criteria, "nct_id").join(profiles, "patient_id"), "calls")
    first = asked(rows, judge, path, "local", each, **how)
    rows = rows.drop("profile") if second is None else rows
    found = rows.join(answered(first).select(*each, F.col("answer").alias("local")), each, "left")
    open_ = failures(first, each).withColumn("side", F.lit("local"))
    if second is None:
        found = found.withColumn("api", F.lit(None).cast(RESULT))
    else:
        band = found.filter(scoring.in_band(F.col("local.confidence"))).select(*each, "profile", "text")
        again = asked(band, second, path, "api", each, **how)
        found = found.drop("profile").join(answered(again).select(*each, F.col("answer").alias("api")), each, "left")
        open_ = open_.unionByName(failures(again, each).withColumn("side", F.lit("api")))
    missing = readers.scratch(open_.join(rows.select(*each, "kind", "idx").distinct(), each), "failures")
    done = found.join(missing.select(*keys).distinct(), list(keys), "left_anti")
    return verdicts(settled(done.withColumn("api", F.when(scoring.in_band(F.col("local.confidence")), F.col("api"))))), missing
