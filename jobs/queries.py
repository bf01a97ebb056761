"""The jobs as queries over the test tables, with their SQL. Each runs twice into one new folder, which stays."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import call_log, shortlists
from jobs.common import config
from veridex.plans.registry import BM
from veridex.sources.readers import shared_root


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def job1_shortlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "shortlists")
    for _ in range(2):
        shortlists.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{out}/output", config(None, "shortlists.json"))
    return shortlists.read_back(spark, f"{out}/output")


def job2_call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "call-log")
    for _ in range(2):
        call_log.run(spark, f"{sf_dir}/events.parquet*", f"{out}/output", f"{out}/checkpoint", config(None, "call_log.json"))
    return call_log.read_back(spark, f"{out}/output")


QUERIES = {"job1_shortlists": job1_shortlists, "job2_call_log": job2_call_log}

ORACLE_SQL = {
    "job1_shortlists": f"""WITH {BM}, t AS (SELECT query, doc, round(score,6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score,9) DESC, doc) AS rank FROM b),
c AS (SELECT query, doc_id AS doc, count(*) AS n_terms, string_agg(term, ' ' ORDER BY term) AS terms FROM p JOIN q USING (term) GROUP BY ALL)
SELECT query, rank, doc, score, n_terms, terms, nullif(lang,'') AS lang FROM t JOIN c USING (query, doc) JOIN documents ON doc_id=doc WHERE rank<=10""",
    "job2_call_log": """WITH s AS (SELECT strftime(ts,'%Y-%m-%d') AS day, event_type, greatest(round(value*100),0)::BIGINT AS step FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY day, event_type ORDER BY step) AS nth, count(step) OVER (PARTITION BY day, event_type) AS n FROM s)
SELECT day, event_type, count(*) AS n_calls, count(*) FILTER (event_type='error') AS n_failed, sum(step)::BIGINT AS total, min(step) AS least, max(step) AS most,
min(step) FILTER (nth*100>=n*50) AS p50, min(step) FILTER (nth*100>=n*95) AS p95 FROM r GROUP BY 1, 2""",
}
