"""The paged source against a server of its own, and sinks that write once."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from veridex.sources import readers
from veridex.streaming.incremental import STATE_STORE, evaluate_stream


@pytest.fixture
def server(spark):
    """Studies by status, in pages of at most ``size``; ``asked`` are the requests' parameters."""

    class Server(BaseHTTPRequestHandler):
        studies = {"RECRUITING": [f"R{k}" for k in range(7)], "COMPLETED": ["C0", "C1"]}
        size, asked = 3, []

        def do_GET(self):
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            Server.asked.append(q)
            at, have = int(q.get("pageToken", "0")), Server.studies.get(q["filter.overallStatus"], [])
            size = min(Server.size, int(q["pageSize"]))
            page = {"studies": [{"protocolSection": {"identificationModule": {"nctId": n}, "statusModule": {"overallStatus": q["filter.overallStatus"]}}} for n in have[at : at + size]]}
            if at + size < len(have):
                page["nextPageToken"] = str(at + size)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(page).encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    spark.dataSource.register(readers.StudySource)
    Server.url = f"http://127.0.0.1:{http.server_port}/studies"
    yield Server
    http.shutdown()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_filter_of_the_status_is_the_sources_own(spark, server):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("studies").options(url=server.url, pause="0", pushdown="true").load()
        some = rows.filter("status = 'COMPLETED' and nct_id <> 'C0'").select("nct_id")
        assert [r.nct_id for r in some.collect()] == ["C1"] and {q["filter.overallStatus"] for q in server.asked} == {"COMPLETED"}
        filters = [line for line in plan(some).splitlines() if "Filter " in line]
        assert filters and not any("COMPLETED" in line for line in filters)
        assert rows.filter("status = 'COMPLETED' and status = 'RECRUITING'").count() == 0
        assert rows.filter("status = 'other'").count() == 0 and rows.count() == 7
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_columns_are_the_fields_that_are_asked_for(spark, server):
    rows = spark.read.format("studies").schema("status string, nct_id string").options(url=server.url, limit="4", pause="0").load()
    assert [tuple(r) for r in rows.collect()] == [("RECRUITING", f"R{k}") for k in range(4)]
    assert {q["fields"] for q in server.asked} == {"OverallStatus,NCTId"} and [q["pageSize"] for q in server.asked] == ["4", "1"]
    raw = spark.read.format("studies").options(url=server.url, status="COMPLETED", pause="0").load()
    assert json.loads(raw.select("study").first()[0])["protocolSection"]["identificationModule"] == {"nctId": "C0"}
    for options in ({"status": "OTHER"}, {}):
        with pytest.raises(Exception, match="status must be|no such columns"):
            (spark.read.format("studies").schema("nct_id string" if options else "other string").options(url=server.url, **options).load()).collect()


def test_a_stream_of_pages_goes_on_without_loss_or_repeats(spark, server, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        rows = spark.readStream.format("studies").schema("nct_id string").options(url=server.url, pause="0").load()
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.nct_id for r in spark.read.schema("nct_id string").parquet(out).collect())

    assert run() == [f"R{k}" for k in range(7)]
    read = [q for q in server.asked if q["fields"] == "NCTId"]
    assert len(read) == len(server.asked)
    assert run() == [f"R{k}" for k in range(7)]
    server.studies = server.studies | {"RECRUITING": [f"R{k}" for k in range(14)]}  # the last page grows, others follow
    assert run() == sorted(f"R{k}" for k in range(14))
    assert run() == sorted(f"R{k}" for k in range(14))


def test_a_range_of_pages_is_read_again_as_it_was(server):
    stream = readers._StudyStream(readers._Asked({"url": server.url, "pause": "0"}, ["nct_id"]))
    end = stream.latestOffset()
    assert end == {"page": 2, "token": "6", "taken": 1}
    server.studies = server.studies | {"RECRUITING": [f"R{k}" for k in range(20)]}
    again = readers._StudyStream(readers._Asked({"url": server.url, "pause": "0"}, ["nct_id"]))
    names = lambda a, b: [r[0] for p in again.partitions(a, b) for r in again.read(p)]
    assert names(again.initialOffset(), end) == [f"R{k}" for k in range(7)]
    assert names(end, again.latestOffset()) == [f"R{k}" for k in range(7, 20)] and names(end, end) == []


def test_a_log_batch_that_comes_again_is_there_once(spark, tmp_path):
    rows, log = spark.range(5), str(tmp_path / "log")
    for k, some in (("0", rows), ("1", rows.limit(2)), ("0", rows)):
        readers.append_log(some, log, k)
    assert spark.read.json(log).groupBy("batch").count().orderBy("batch").collect() == [(0, 5), (1, 2)]


def test_a_log_stream_writes_each_row_once_over_restarts(spark, tmp_path, monkeypatch):
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "checkpoint"))
    run = lambda: readers.log_stream(spark.readStream.schema("id long").parquet(source), log, checkpoint).awaitTermination(120)
    spark.range(4).coalesce(1).write.parquet(source)
    real = readers.append_log

    def lost(*args):
        real(*args)
        raise RuntimeError("after the write")

    monkeypatch.setattr(readers, "append_log", lost)
    with pytest.raises(Exception, match="after the write"):
        run()
    monkeypatch.setattr(readers, "append_log", real)
    run()
    spark.range(4, 6).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(r.id for r in spark.read.json(log).collect()) == list(range(6))


def test_evaluated_trials_are_not_read_again(spark, tmp_path):
    source, out, before = str(tmp_path / "in"), str(tmp_path / "out"), spark.conf.get(STATE_STORE)
    seen = []

    def evaluate(rows):
        seen.append(sorted(r.nct_id for r in rows.collect()))
        return rows.withColumn("score", F.lit(1.0))

    def run(name="check"):
        evaluate_stream(spark.readStream.schema("nct_id string").parquet(source), evaluate, out, str(tmp_path / name)).awaitTermination(120)

    add = lambda *names: spark.createDataFrame([(n,) for n in names], "nct_id string").coalesce(1).write.mode("append").parquet(source)
    add("a", "b", "a")
    run()
    add("b", "c")
    run()
    run()
    assert seen == [["a", "b"], ["c"]] and spark.conf.get(STATE_STORE) == before
    assert list((tmp_path / "check" / "state").glob("**/*.zip")) or list((tmp_path / "check" / "state").glob("**/*.changelog"))  # on disk
    run("other")
    assert sorted(r.nct_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"] and seen[-1] == []
