"""Calls that fail, runs that break off, and what is left of both."""

import json
import os
import threading
from collections import Counter
from dataclasses import dataclass
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.test_cli import study
from tests.test_operators import PATIENT_ROW
from veridex import cli
from veridex.operators import answers, judging, scoring
from veridex.sources import readers


@dataclass(frozen=True)
class Counting:
    """Notes each call in a file; fails for good where a criterion has one of the words, while the file ``broken`` is there."""

    folder: str
    bad: tuple[str, ...] = ()
    confidence: float = 0.9
    backend: str = "local"
    model: str = "counting"

    def ready(self):
        pass

    def complete(self, profile, criterion):
        with open(f"{self.folder}/{self.backend}", "a") as f:
            f.write(criterion + "\n")
        if os.path.exists(f"{self.folder}/broken") and any(w in criterion.split() for w in self.bad):
            raise judging.JudgeError(f"no answer to {criterion}")
        return judging.Completion(json.dumps({"eligible": True, "confidence": self.confidence, "reasoning": "r", "patient_feature": "f"}), 1, 2)

    def made(self):
        return Counter(open(f"{self.folder}/{self.backend}").read().splitlines())


@pytest.fixture
def broken(tmp_path):
    (tmp_path / "broken").touch()
    return str(tmp_path)


def test_one_call_of_a_thousand_fails(spark, tmp_path, broken):
    judge, out = Counting(broken, ("c7",)), f"{tmp_path}/answers"
    calls = spark.range(1000).select(F.col("id"), F.lit("p").alias("profile"), F.concat(F.lit("c"), "id").alias("text"))
    first = answers.asked(calls, judge, out, "local", ["id"], at_once=300)
    assert answers.answered(first).count() == 999 and set(judge.made().values()) == {1}
    assert [tuple(r) for r in answers.failures(first, ["id"]).collect()] == [(7, "JudgeError: no answer to c7")]
    assert first.select("chunk").distinct().count() == 4
    os.remove(f"{broken}/broken")
    again = answers.asked(calls.union(calls.limit(5)), judge, out, "local", ["id"], at_once=300)
    assert judge.made() == {f"c{k}": 1 + (k == 7) for k in range(1000)}
    assert answers.answered(again).select("id").distinct().count() == answers.answered(again).count() == 1000 and answers.failures(again, ["id"]).isEmpty()
    assert answers.asked(calls, judge, out, "local", ["id"]).count() == 1001 and sum(judge.made().values()) == 1001


def test_a_run_that_breaks_off_keeps_its_chunks(spark, tmp_path, broken, monkeypatch):
    judge, out = Counting(broken), f"{tmp_path}/answers"
    calls = spark.range(100).select(F.col("id"), F.lit("p").alias("profile"), F.concat(F.lit("c"), "id").alias("text"))
    real, chunks = answers.judged, []

    def breaks(*args):
        chunks.append(1)
        if len(chunks) == 3:
            raise KeyboardInterrupt
        return real(*args)

    monkeypatch.setattr(answers, "judged", breaks)
    with pytest.raises(KeyboardInterrupt):
        answers.asked(calls, judge, out, "local", ["id"], at_once=25)
    n = sum(judge.made().values())
    assert 0 < n < 100 and answers.kept(spark, out, {"id": "bigint"}).count() == n
    assert answers.asked(calls, judge, out, "local", ["id"], at_once=25).count() == 100 and set(judge.made().values()) == {1}


def test_chunks_are_asked_together_by_the_tasks_of_one(spark, tmp_path, broken, monkeypatch):
    judge, scratch, judged, staged, parts = Counting(broken), readers.scratch, answers.judged, [], []
    calls = spark.range(1000).select(F.col("id"), F.lit("p").alias("profile"), F.concat(F.lit("c"), "id").alias("text"))

    def counted(some, *more):
        parts.append((threading.get_ident(), some.rdd.getNumPartitions()))
        return judged(some, *more)

    monkeypatch.setattr(answers, "judged", counted)
    monkeypatch.setattr(readers, "scratch", lambda *x: staged.append(scratch(*x)) or staged[-1])
    found = answers.asked(calls, judge, f"{tmp_path}/answers", "local", ["id"], at_once=100, tasks=8)
    assert found.count() == 1000 and set(judge.made().values()) == {1} and found.select("chunk", "side").distinct().count() == 10
    assert len(parts) == 10 and {n for _, n in parts} == {2} and len({t for t, _ in parts}) == 4
    assert len(staged[0].inputFiles()) == 10


def test_a_task_that_only_fails_gives_up(spark, tmp_path, broken):
    judge = Counting(broken, ("bad",))
    calls = spark.range(50).select("id", F.lit("p").alias("profile"), F.lit("bad").alias("text"))
    found = answers.asked(calls, judge, f"{tmp_path}/answers", "local", ["id"], tasks=2, give_up=4)
    assert judge.made() == {"bad": 8} and answers.failures(found, ["id"]).count() == 50
    assert judging.call_log(found.withColumns({c: F.lit(None) for c in ("patient_id", "nct_id", "kind", "idx")}), "v").count() == 8


def test_transient_failures_are_tried_again_and_counted(spark, tmp_path, broken):
    @dataclass(frozen=True)
    class Away(Counting):
        def complete(self, profile, criterion):
            super().complete(profile, criterion)
            raise judging.TransientJudgeError("away")

    judge = Away(broken)
    calls = spark.createDataFrame([(1, None, None)], "id long, profile string, text string")
    row = answers.asked(calls, judge, f"{tmp_path}/answers", "local", ["id"], sleep=lambda s: None).first()
    assert (row.answer.attempts, row.answer.error, row.answer.eligible) == (4, "TransientJudgeError: away", None) and sum(judge.made().values()) == 4


def test_null_keys_and_no_calls(spark, tmp_path, broken):
    judge, calls = Counting(broken), spark.createDataFrame([(None, "p", "a"), (None, "p", "a"), (1, "p", "b")], "id long, profile string, text string")
    for _ in range(2):
        assert answers.asked(calls, judge, f"{tmp_path}/answers", "local", ["id"]).count() == 2
    assert judge.made() == {"a": 1, "b": 1}
    assert answers.asked(calls.limit(0), judge, f"{tmp_path}/none", "local", ["id"]).count() == 0


@pytest.fixture
def inputs(spark, tmp_path):
    texts = {"N1": "Inclusion Criteria:\n* one\n* two", "N2": "Inclusion Criteria:\n* three\n* four", "N3": ""}
    (tmp_path / "s.json").write_text(json.dumps([study(k, f"trial {k}", t) for k, t in texts.items()]))
    (tmp_path / "p.json").write_text(json.dumps([PATIENT_ROW]))
    assert cli.main(["parse", "--studies", str(tmp_path / "s.json"), "--out", str(tmp_path / "trials")]) == 0
    return spark.read.parquet(str(tmp_path / "trials")), readers.patients(spark, str(tmp_path / "p.json")), str(tmp_path / "e")


@pytest.mark.parametrize("side", ["local", "api"])
def test_a_failed_call_costs_its_own_trial_until_the_next_run(spark, inputs, broken, side):
    trials, people, out = inputs
    first = Counting(broken, ("four",) if side == "local" else (), 0.5)
    second = Counting(broken, ("four",) if side == "api" else (), 0.8, "api")
    run = lambda: cli.evaluate(spark, trials, people, date(2026, 1, 1), first, second, out)
    with pytest.raises(judging.JudgeError, match="1 calls failed.*no answer to four"):
        run()
    done, rows = cli.finished(spark, out)
    assert {r.nct_id for r in done.collect()} == {"N1", "N3"} and {r.text for r in rows.collect()} == {"one", "two"}
    log = spark.read.json(f"{out}/log")
    assert log.filter("error is not null").count() == 1
    os.remove(f"{broken}/broken")
    run()
    done, rows = cli.finished(spark, out)
    assert sorted(r.nct_id for r in done.collect()) == ["N1", "N2", "N3"] and sorted(r.text for r in rows.collect()) == ["four", "one", "three", "two"]
    again = 1 + (side == "local")
    assert first.made() == {"one": 1, "two": 1, "three": 1, "four": again} and second.made() == {"one": 1, "two": 1, "three": 1, "four": 3 - again}
    assert spark.read.json(f"{out}/log").count() == sum(first.made().values()) + sum(second.made().values())
    assert {r.route for r in rows.collect()} == {"api"} and cli.summary(spark, out)["n_trials"] == 3


def test_a_crash_between_tables_doubles_nothing(spark, inputs, broken, monkeypatch):
    trials, people, out = inputs
    judge, real = Counting(broken), scoring.evaluated
    monkeypatch.setattr(scoring, "evaluated", lambda *a, **b: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        cli.evaluate(spark, trials, people, date(2026, 1, 1), judge, None, out)
    monkeypatch.setattr(scoring, "evaluated", real)
    cli.evaluate(spark, trials, people, date(2026, 1, 1), judge, None, out)
    spark.read.parquet(f"{out}/verdicts").drop("run").withColumn("run", F.lit("lost")).write.mode("append").partitionBy("run").parquet(f"{out}/verdicts")
    assert cli.finished(spark, out)[1].count() == 4 and cli.summary(spark, out)["n_criteria"] == 4
    assert set(judge.made().values()) == {1} and spark.read.json(f"{out}/log").count() == 4


def test_another_judge_cannot_go_on_even_after_a_failure(spark, inputs, broken):
    trials, people, out = inputs
    with pytest.raises(judging.JudgeError):
        cli.evaluate(spark, trials, people, date(2026, 1, 1), Counting(broken, ("one", "three")), None, out)
    with pytest.raises(ValueError, match="judge"):
        cli.evaluate(spark, trials, people, date(2026, 1, 1), Counting(broken, model="other"), None, out)
