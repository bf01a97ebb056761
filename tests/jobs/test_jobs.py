"""The jobs: against their SQL, on growing input, run again, after a failure, and from the command line."""

import glob
import json
import logging
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import call_log, queries, shortlists
from jobs.common import config

SF = "/root/testdata/sf0.001"
LOG = config(None, "call_log.json")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def compared(df, con, sql):
    names = sorted(df.columns)
    found = con.execute(sql)
    at = [[c[0] for c in found.description].index(n) for n in names]
    return sorted(repr(tuple(r)) for r in df.select(*names).collect()), sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    settings = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    ours, theirs = compared(queries.QUERIES[name](spark, SF), tables, queries.ORACLE_SQL[name])
    assert ours == theirs and ours
    assert settings == {k: spark.conf.get(k) for k in settings}


def files(folder):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def test_call_log_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    events, log, out = spark.read.parquet(f"{SF}/events.parquet"), f"{tmp_path}/log", f"{tmp_path}/out"
    times = sorted(r["ts"] for r in events.select("ts").collect())
    cut = times[len(times) * 6 // 10]
    run = lambda: call_log.run(spark, log, out, f"{tmp_path}/checkpoint", LOG)
    want = lambda: compared(call_log.read_back(spark, out), _over(log), queries.ORACLE_SQL["job2_call_log"])
    old = events.filter(F.col("ts") <= cut)
    late = events.filter(F.col("ts") > cut).union(events.filter("event_id = 0"))  # and one call of the first day again
    old.repartition(3).write.mode("append").parquet(log)
    assert run()["rows"] == old.count()
    ours, theirs = want()
    assert ours == theirs
    counts, first = files(f"{out}/counts"), files(f"{out}/days")
    assert run() == {"batches": 0, "rows": 0} and files(f"{out}/counts") == counts and files(f"{out}/days") == first
    late.coalesce(1).write.mode("append").parquet(log)
    assert run()["rows"] == late.count()
    ours, theirs = want()
    assert ours == theirs
    days = lambda found: {f.split("day=")[1][:10] for f in found}
    touched = days(f for f, t in files(f"{out}/days").items() if first.get(f) != t)
    assert touched == {str(r["d"]) for r in late.select(F.to_date("ts").alias("d")).distinct().collect()}
    assert counts.items() <= files(f"{out}/counts").items()  # old counts stay as they were
    assert any("read" in r.getMessage() and "wrote" in r.getMessage() for r in caplog.records)


def _over(log):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{log}/*.parquet'")
    return con


def test_a_batch_that_is_repeated_counts_once(spark, tmp_path):
    calls, out = spark.read.schema(call_log.LOG).parquet(f"{SF}/events.parquet"), f"{tmp_path}/out"
    call_log.taken(calls.filter("event_id % 2 = 0"), 0, out, LOG)
    call_log.taken(calls.filter("event_id % 2 = 1"), 1, out, LOG)
    call_log.taken(calls.filter("event_id % 2 = 1"), 1, out, LOG)
    ours, theirs = compared(call_log.read_back(spark, out), _tables_of_events(), queries.ORACLE_SQL["job2_call_log"])
    assert ours == theirs


def _tables_of_events():
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    return con


def test_a_failed_batch_is_taken_by_the_next_run(spark, tmp_path, monkeypatch):
    log, out, checkpoint = f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    spark.read.parquet(f"{SF}/events.parquet").repartition(4).write.parquet(log)
    real, seen = call_log.replaced, []

    def fails(rows, path, *by):
        seen.append(path)
        if len(seen) == 2:  # the counts are there, the days aren't
            raise RuntimeError("lost")
        real(rows, path, *by)

    monkeypatch.setattr(call_log, "replaced", fails)
    with pytest.raises(Exception, match="lost"):
        call_log.run(spark, log, out, checkpoint, LOG)
    call_log.run(spark, log, out, checkpoint, LOG)
    ours, theirs = compared(call_log.read_back(spark, out), _over(log), queries.ORACLE_SQL["job2_call_log"])
    assert ours == theirs


def test_call_log_of_odd_rows(spark, tmp_path):
    rows = [(1, None, 1, "click", 1.0, None), (2, None, 1, None, None, None), (3, None, 1, None, -2.0, None), (4, None, 1, "error", 0.004, None)]
    log = f"{tmp_path}/log"
    spark.createDataFrame(rows, call_log.LOG).withColumn("extra", F.lit(1)).coalesce(1).write.parquet(log)
    call_log.run(spark, log, f"{tmp_path}/out", f"{tmp_path}/checkpoint", LOG)
    got = {r.event_type: (r.day, r.n_calls, r.n_failed, r.total, r.least, r.most, r.p50, r.p95) for r in call_log.read_back(spark, f"{tmp_path}/out").collect()}
    assert got == {"click": (None, 1, 0, 100, 100, 100, 100, 100), None: (None, 2, 0, 0, 0, 0, 0, 0), "error": (None, 1, 1, 0, 0, 0, 0, 0)}


def test_call_log_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], call_log.LOG).coalesce(1).write.parquet(f"{tmp_path}/log")
    call_log.run(spark, f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/checkpoint", LOG)
    call_log.run(spark, f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/checkpoint", LOG)


def test_shortlists_again_and_partitioned(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    out, again = f"{tmp_path}/out", []
    for _ in range(2):
        shortlists.run(spark, f"{SF}/documents.parquet", f"{SF}/benchmark.parquet", out, {"top_k": 3, "every": 10})
        again.append(sorted(map(tuple, shortlists.read_back(spark, out).collect())))
    assert again[0] == again[1] and {r[1] for r in again[0]} == {1, 2, 3}
    assert all(os.path.basename(os.path.dirname(f)).startswith("lang=") for f in files(out))
    said = " ".join(r.getMessage() for r in caplog.records)
    assert "read 200 documents" in said and f"wrote {len(again[0])} rows" in said


def test_shortlists_of_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "kras lung cancer", ""), (2, None, "en"), (3, "", None), (4, "lung lung", "en"), (5, "breast", "fr")], "doc_id long, text string, lang string").withColumn("term", F.lit("x"))
    asked = spark.createDataFrame([(0, "lung KRAS"), (10, None), (20, "the of")], "query long, text string")
    got = [(r.query, r["rank"], r.doc, r.n_terms, r.terms, r.lang) for r in shortlists.shortlists(docs, asked, 5).orderBy("query", "rank").collect()]
    assert got == [(0, 1, 1, 2, "kras lung", None), (0, 2, 4, 1, "lung", "en")]
    assert shortlists.shortlists(docs.limit(0), asked, 5).count() == 0


def test_shortlists_leave_postings_where_they_are(spark):
    """Neither counting words nor joining them with searches and found documents shuffles postings, however large Spark thinks
    these are."""
    docs = spark.createDataFrame([(k, f"cancer lung w{k}", "en") for k in range(50)], "doc_id long, text string, lang string")
    plan = shortlists.shortlists(docs, docs.limit(3).select(F.col("doc_id").alias("query"), "text"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan and plan.count("postings-") == 1


def test_settings(tmp_path):
    own = tmp_path / "own.json"
    own.write_text('{"top_k": 2}')
    assert config(str(own), "shortlists.json") == {"top_k": 2, "every": 50}
    own.write_text('{"topk": 2}')
    with pytest.raises(ValueError, match="topk"):
        config(str(own), "shortlists.json")


def test_command_line(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"top_k": 2}))
    for _ in range(2):
        done = subprocess.run([sys.executable, "-m", "jobs.call_log", "--log", f"{SF}/events.parquet*", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/checkpoint"], cwd=root, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
    assert glob.glob(f"{tmp_path}/out/days/day=*/*.parquet")
