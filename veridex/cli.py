"""Commands: ``example-patient``, ``fetch``, ``parse``, ``retrieve``, ``evaluate``, ``rank``.

Exit 0, 2 without a judge, 3 where a call failed for good; every other call's answer is kept, and a second run asks for the rest.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
import uuid
from datetime import date, datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.functions.text import tokens
from veridex.operators import answers, ingest, judging, patient, report, retrieval, scoring
from veridex.operators.judging import Judge, JudgeError, JudgeUnavailable, RulesJudge
from veridex.sources import readers

PAIR = ("patient_id", "nct_id")
#: Patients that are held against every trial; more of them need ``--candidates``.
MOST_PATIENTS = 1000


def candidates(trials: DataFrame, people: DataFrame, top_k: int, encoder: retrieval.Encoder) -> DataFrame:
    """The best trials of each patient by words and vectors: ``patient_id, nct_id, retrieval_score, retrieval``."""
    docs = readers.scratch(ingest.trial_documents(trials).select(F.col("nct_id").alias("doc"), "text"), "trial-texts")
    posts = readers.scratch(retrieval.postings(docs, "doc", "text"), "postings")
    asked = people.select(F.col("patient_id").alias("query"), patient.query().alias("text"))
    vectors, wanted = (readers.scratch(retrieval.encoded(rows, key, "text", encoder, name), "vectors") for rows, key, name in ((docs, "doc", "embedding"), (asked, "query", "vector")))
    found = retrieval.search(posts, asked.select("query", F.explode(tokens(F.col("text"))).alias("term")), vectors, wanted, top_k, retrieval.corpus_totals(docs, "text"))
    return found.select(F.col("query").alias("patient_id"), F.col("doc").alias("nct_id"), *decorated())


def decorated() -> list:
    """A candidate's score and where it comes from, as rounded for reading."""
    ranks = [F.col(c).cast("int").alias(c) for c in ("bm25_rank", "dense_rank")]
    return [F.round("rrf", 6).alias("retrieval_score"), F.struct(*ranks, *(F.round(c, 4).alias(c) for c in ("bm25_score", "dense_score"))).alias("retrieval")]


def evaluate(spark: SparkSession, trials: DataFrame, people: DataFrame, as_of: date, judge: Judge, second: Judge | None, out: str, chosen: DataFrame | None = None, version: str = "none") -> DataFrame:
    """Every criterion of the pairs of patient and trial that aren't done in ``out`` yet; returns their evaluations.

    Without ``chosen`` (candidates) each of a few patients is held against each trial. Answers are kept as they come; a pair
    with a failed call is left for the next run, which asks for that call alone, and JudgeError is raised once all else is
    written. ``verdicts`` and ``trials`` have the run's name: verdicts count where ``trials``, written last, has their run."""
    began, name = time.monotonic(), uuid.uuid4().hex
    now = {"prompt_version": version, "as_of": as_of.isoformat(), "judge": judging.described(judge), "second": judging.described(second)}
    judge.ready()
    if readers.exists(spark, f"{out}/settings"):
        done = json.loads(spark.read.text(f"{out}/settings").filter("value <> ''").first()["value"])
        judging.same_run(done, now, ("prompt_version", "as_of", "judge", "second"))
    if chosen is None:
        if people.limit(MOST_PATIENTS + 1).count() > MOST_PATIENTS:
            raise ValueError(f"more than {MOST_PATIENTS} patients: give their candidates")
        chosen = trials.select("nct_id").crossJoin(F.broadcast(people.select("patient_id"))).withColumn("retrieval_score", F.lit(None).cast("double"))  # at most MOST_PATIENTS
    if readers.exists(spark, f"{out}/trials"):
        chosen = judging.still_to_do(chosen, spark.read.parquet(f"{out}/trials"), PAIR)
    chosen = readers.scratch(chosen.select(*PAIR, "retrieval_score"), "pairs")
    if not readers.exists(spark, f"{out}/settings"):
        spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.text(f"{out}/settings")
    rows, missing = answers.evaluate(chosen, ingest.criteria_rows(trials), people.select("patient_id", patient.summary(as_of).alias("profile")), judge, second, f"{out}/answers")
    rows = readers.scratch(rows.withColumns({"reasoning": F.col("final.reasoning"), "evidence": F.col("final.patient_feature")}), "verdicts")
    write_log(spark, trials, out, version)
    about = judging.still_to_do(chosen, missing, PAIR).join(trials.select("nct_id", "title", "phase", F.transform("interventions", lambda i: i["name"]).alias("interventions")), "nct_id")
    found = readers.scratch(scoring.evaluated(about, rows, PAIR, details=("kind", "text", "reasoning", "evidence")), "evaluated")
    for table, what in (("verdicts", rows), ("trials", found)):
        if table == "verdicts" or not what.isEmpty():
            what.withColumn("run", F.lit(name)).write.mode("append").partitionBy("run").parquet(f"{out}/{table}")
    spark.createDataFrame([(json.dumps(now | {"generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "wall_time_s": round(time.monotonic() - began, 1), "runtime": judging.runtime()}),)], "value string").write.mode("append").text(f"{out}/run")
    if (first := missing.limit(1).collect()):
        raise JudgeError(f"{missing.count()} calls failed; all else is in {out}. One of them: {first[0]['error']}")
    return found


def write_log(spark: SparkSession, trials: DataFrame, out: str, version: str) -> None:
    """Appends the calls of those chunks of answers to the log that it doesn't have yet, whichever run made them."""
    made = answers.kept(spark, f"{out}/answers", {"patient_id": "string", "nct_id": "string", "pos": "int"})
    if readers.exists(spark, f"{out}/log"):
        made = made.join(spark.read.schema("chunk STRING").json(f"{out}/log").distinct(), "chunk", "left_anti")
    criteria = ingest.criteria_rows(trials).select("nct_id", "pos", "kind", "idx")
    rows = judging.call_log(made.join(criteria, ["nct_id", "pos"]), version, "chunk")
    rows.write.mode("append").partitionBy("chunk").json(f"{out}/log")


def finished(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Trials and their verdicts; those of a run that broke off before its trials were written aren't among them."""
    trials = spark.read.parquet(f"{out}/trials")
    return trials, spark.read.parquet(f"{out}/verdicts").join(trials.select("run").distinct(), "run", "left_semi")


def summary(spark: SparkSession, out: str, patient_id: str | None = None) -> dict:
    """The run's headline numbers, of one patient or of all; wall time is summed up over resumed runs."""
    trials, rows = finished(spark, out)
    if patient_id is not None:
        trials, rows = (t.filter(F.col("patient_id") == patient_id) for t in (trials, rows))
    runs = [json.loads(r["value"]) for r in spark.read.text(f"{out}/run").filter("value <> ''").collect()]  # one small row a run
    last = max(runs, key=lambda r: r["generated_at"])
    model = lambda d: d and d["model"]
    return scoring.run_summary(trials, rows).first().asDict() | {"patient_id": patient_id, "generated_at": last["generated_at"], "prompt_version": last["prompt_version"], "as_of": last["as_of"], "local": model(last["judge"]), "api": model(last["second"]), "wall_time_s": round(sum(r["wall_time_s"] for r in runs), 1), "models": scoring.models(rows).first()["models"]}


def write_reports(spark: SparkSession, evaluated: str, people: DataFrame, out: str, top: int) -> list[str]:
    """A markdown report for each of a few patients; returns their paths."""
    trials, rows = finished(spark, evaluated)
    trials = trials.withColumn("position", F.col("nct_id"))
    ids = [r["patient_id"] for r in trials.select("patient_id").distinct().orderBy("patient_id").limit(MOST_PATIENTS + 1).collect()]
    if len(ids) > MOST_PATIENTS:
        raise ValueError(f"more than {MOST_PATIENTS} patients: read the tables instead")
    Path(out).mkdir(parents=True, exist_ok=True)
    paths = []
    for k, name in enumerate(ids):
        run = summary(spark, evaluated, name)
        profile = people.filter(F.col("patient_id") == name).select(patient.summary(date.fromisoformat(run["as_of"])).alias("x")).first()
        own = lambda t: t.filter(F.col("patient_id") == name)  # noqa: B023, E731
        paths.append(f"{out}/{k:04d}.md")
        Path(paths[-1]).write_text(report.markdown(own(trials), own(rows), run, profile["x"] if profile else "", top), encoding="utf-8")
        report.best(own(trials), "position", top).select("rank", "nct_id", "status", F.format_string("%.3f", "score").alias("score"), F.concat_ws("/", "n_pass", "n_fail", "n_unknown").alias("pass/fail/unknown"), F.substring("title", 1, 60).alias("title")).orderBy("rank").show(top, False)
    return paths


def first_trials(trials: DataFrame, most: int) -> DataFrame:
    """The first ``most`` in the order of the file (0: all)."""
    return trials.orderBy("position").limit(most) if most else trials


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veridex")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in {"example-patient": ("--out",), "parse": ("--studies", "--out"), "retrieve": ("--trials", "--patients", "--out"), "evaluate": ("--trials", "--patients", "--out"), "rank": ("--evaluated", "--patients", "--out"), "fetch": ("--url", "--condition", "--status", "--out")}.items():
        sub = commands.add_parser(name)
        for o in options:
            sub.add_argument(o, required=True)
        sub.add_argument("--top", type=int, default=50 if name == "retrieve" else 10)
        sub.add_argument("--as-of", type=date.fromisoformat, default=date.today())
        sub.add_argument("--max-trials", type=int, default=0)
        sub.add_argument("--candidates")
        sub.add_argument("--server")
        sub.add_argument("--model")
        sub.add_argument("--prompt", help="JSON file: system, example")
        sub.add_argument("--hosted-url")
        sub.add_argument("--hosted-model")
    a = parser.parse_args(argv)
    if a.max_trials < 0:
        parser.error("--max-trials must not be negative")
    spark = SparkSession.builder.appName("veridex").getOrCreate()
    try:
        if a.command == "example-patient":
            readers.write_json(readers.patients(spark, "example"), a.out)
        elif a.command == "fetch":
            spark.dataSource.register(readers.StudySource)
            spark.read.format("studies").options(url=a.url, condition=a.condition, status=a.status, limit=str(a.top)).load().select("study").write.mode("overwrite").text(a.out)
        elif a.command == "parse":
            ingest.parsed_trials(readers.studies(spark, a.studies)).withColumn("position", F.monotonically_increasing_id()).write.mode("overwrite").parquet(a.out)
        elif a.command == "retrieve":
            candidates(spark.read.parquet(a.trials), readers.patients(spark, a.patients), a.top, retrieval.HashedWords()).write.mode("overwrite").parquet(a.out)
        elif a.command == "evaluate":
            judge, second, version = judges(a)
            chosen = spark.read.parquet(a.candidates) if a.candidates else None
            evaluate(spark, first_trials(spark.read.parquet(a.trials), a.max_trials), readers.patients(spark, a.patients), a.as_of, judge, second, a.out, chosen, version)
            print(json.dumps(summary(spark, a.out), indent=2))
        else:
            print("\n".join(write_reports(spark, a.evaluated, readers.patients(spark, a.patients), a.out, a.top)))
    except JudgeUnavailable as e:
        print(e, file=sys.stderr)
        return 2
    except JudgeError as e:
        print(e, file=sys.stderr)
        return 3
    finally:
        readers.clean(spark)
    return 0


def judges(a: argparse.Namespace) -> tuple[Judge, Judge | None, str]:
    """The judges that the options name; without a model, rules without any rule, which leave all open."""
    if not a.model:
        return RulesJudge(()), None, "none"
    spec = json.loads(Path(a.prompt).read_text(encoding="utf-8"))
    prompt = judging.Prompt(spec["system"], tuple(spec["example"]))
    second = judging.HostedJudge.from_environment(prompt, a.hosted_model, a.hosted_url) if a.hosted_model else None
    return judging.ServerJudge(prompt, a.model, judging.server_url(a.server, None)), second, prompt.version


if __name__ == "__main__":
    sys.exit(main())
