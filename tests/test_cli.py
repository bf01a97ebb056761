import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.test_operators import PATIENT_ROW, TEXT
from veridex import cli
from veridex.operators import judging, report, retrieval
from veridex.sources import readers
from veridex.streaming.incremental import evaluate_stream


def study(name, title, text=TEXT):
    return {"protocolSection": {"identificationModule": {"nctId": name, "briefTitle": title}, "eligibilityModule": {"eligibilityCriteria": text}}}


@pytest.fixture
def files(tmp_path):
    at = lambda n: str(tmp_path / n)
    (tmp_path / "s.json").write_text(json.dumps([study("N2", "KRAS lung | trial"), study("N1", "heart trial"), study("N3", "skin trial", "")]))
    (tmp_path / "p.json").write_text(json.dumps([PATIENT_ROW, PATIENT_ROW | {"patient_id": "q", "diagnosis": "Melanoma of the skin", "mutations": []}]))
    assert cli.main(["parse", "--studies", at("s.json"), "--out", at("trials")]) == 0
    return at


def test_commands(spark, files, capsys):
    at = files
    assert cli.main(["example-patient", "--out", at("example")]) == 0 and readers.patients(spark, at("example")).count() == 1
    assert cli.main(["retrieve", "--trials", at("trials"), "--patients", at("p.json"), "--out", at("c")]) == 0
    found = {r.patient_id: r for r in spark.read.parquet(at("c")).filter("retrieval.bm25_rank = 1").collect()}
    assert found["p"].nct_id == "N2" and found["q"].nct_id == "N3" and found["p"].retrieval.dense_rank in (1, 2, 3)
    evaluate = ["evaluate", "--trials", at("trials"), "--patients", at("p.json"), "--out", at("e"), "--as-of", "2026-01-01"]
    for most in ("1", "0", "0"):  # the first of the file, then the rest, then nothing
        assert cli.main([*evaluate, "--max-trials", most, "--candidates", at("c")]) == 0
        if most == "1":
            assert {r.nct_id for r in spark.read.parquet(at("e/trials")).collect()} == {"N2"}
    rows = {(r.patient_id, r.nct_id): r for r in spark.read.parquet(at("e/trials")).collect()}
    assert len(rows) == spark.read.parquet(at("e/trials")).count() == 6
    assert rows["p", "N1"].n_criteria == 4 and rows["q", "N2"].n_unknown == 4 and rows["p", "N3"].note and rows["p", "N2"].retrieval_score > 0.03
    assert spark.read.json(at("e/log")).count() == 16
    run = cli.summary(spark, at("e"))
    assert (run["n_trials"], run["n_criteria"], run["models"], run["api"]) == (6, 16, ["rules"], None) and run["wall_time_s"] > 0
    with pytest.raises(ValueError, match="as_of"):
        cli.main([*evaluate[:-1], "2026-01-02"])
    assert cli.main(["rank", "--evaluated", at("e"), "--patients", at("p.json"), "--out", at("r"), "--top", "2"]) == 0
    text = (open(at("r/0000.md")).read(), open(at("r/0001.md")).read())
    assert text[0].startswith("# Trial matches for p\n\nGenerated ") and "Diagnosis: Melanoma of the skin" in text[1] and "KRAS lung \\| trial" in text[0]
    assert text[0].count("\n## ") == 2 and text[0].count("| unknown |") == 8 - 4 * ("N3" in text[0])


YES, NO, UNSURE = (True, 0.95), (False, 0.9), (True, 0.5)


def test_two_judges_and_a_blocker(spark, files):
    """The second judge is asked in the band alone, and its word counts; a blocker shows in the report."""
    at = files
    first = judging.RulesJudge(((("brain",), False, 0.9), (("kras",), True, 0.9), (("ecog",), True, 0.5)), YES)
    second = judging.RulesJudge((), (False, 0.8), backend="api", model="second")
    trials, people = spark.read.parquet(at("trials")), readers.patients(spark, at("p.json"))
    cli.evaluate(spark, trials, people, date(2026, 1, 1), first, second, at("e"))
    rows = spark.read.parquet(at("e/verdicts")).filter("nct_id = 'N2' and patient_id = 'p'")
    found = {r.text[:4]: r for r in rows.collect()}
    assert {k: r.route for k, r in found.items()} == {"Aged": "local", "ECOG": "api", "Prio": "local", "brai": "local"}
    assert found["ECOG"].final.eligible is False and found["ECOG"].api.model == "second" and found["Aged"].api is None
    trial = spark.read.parquet(at("e/trials")).filter("nct_id = 'N2' and patient_id = 'p'")
    assert [(b.kind, b.idx) for b in trial.first().blocking] == [("inclusion", 1), ("exclusion", 0)] and trial.first().n_routed_api == 1
    text = report.markdown(trial.withColumn("position", F.lit(0)), rows, cli.summary(spark, at("e"), "p"), "the profile")
    lines = text.splitlines()
    assert lines[2].endswith("local `rules` · API `second`") and "```" == lines[6] and lines[7] == "the profile"
    at_blocking = lines.index("**Blocking criteria**")
    assert lines[at_blocking + 1].startswith("- *inclusion #1*: ECOG") and lines[at_blocking + 2].startswith("  → rule (evidence: none)") and lines[at_blocking + 5] == ""
    assert [line.split(" | ")[0] for line in lines[at_blocking + 8 :]] == ["| inc", "| inc", "| exc", "| exc"]


class Broken:
    backend = model = "broken"

    def ready(self):
        pass

    def complete(self, profile, criterion):
        raise judging.JudgeError("gone for good")


def test_exit_codes(spark, files, monkeypatch):
    at = files
    options = ["evaluate", "--trials", at("trials"), "--patients", at("p.json"), "--out", at("x")]
    monkeypatch.setattr(cli, "judges", lambda a: (Broken(), None, "v"))
    assert cli.main(options) == 3
    refuse = lambda *a: (_ for _ in ()).throw(judging.TransientJudgeError("no connection"))
    monkeypatch.setattr(cli, "judges", lambda a: (judging.ServerJudge(judging.Prompt("s", ("p", "c", "a")), "m", call=refuse), None, "v"))
    assert cli.main(options) == 2


def test_server_and_hosted_judges(monkeypatch):
    prompt, asked = judging.Prompt("rules", ("p", "c", "a")), []

    def call(url, body, headers, timeout=0):
        asked.append((url, body, headers))
        if url.endswith("/tags"):
            return {"models": [{"name": "small:14b"}]}
        return {"message": {"content": "{}"}, "prompt_eval_count": 7, "eval_count": 3} if "chat" in url else {"content": [{"type": "text", "text": "{"}, {"type": "text", "text": "}"}], "usage": {"input_tokens": 1}}

    server = judging.ServerJudge(prompt, "small", "http://x", call=call)
    server.ready()
    with pytest.raises(judging.JudgeUnavailable):
        judging.ServerJudge(prompt, "other", "http://x", call=call).ready()
    assert server.complete("profile", " criterion ") == judging.Completion("{}", 7, 3)
    assert asked[-1][1]["options"] == {"temperature": 0, "seed": 0} and asked[-1][1]["messages"][-1]["content"] == "profile\n\nCRITERION\ncriterion"
    monkeypatch.delenv("JUDGE_API_KEY", raising=False)
    assert judging.HostedJudge.from_environment(prompt, "m", "http://y") is None
    monkeypatch.setenv("JUDGE_API_KEY", "k")
    hosted = judging.HostedJudge.from_environment(prompt, "m", "http://y")
    assert judging.HostedJudge(prompt, "m", hosted.key, "http://y", call=call).complete("p", "c") == judging.Completion("{}", 1, None) and asked[-1][2] == {"x-api-key": "k"}
    assert len(prompt.version) == 12 and judging.described(server) == {"backend": "local", "model": "small"} and judging.described(None) is None


def test_search_equals_sorting_everything(spark, monkeypatch):
    """In one block of queries and in several; ties of scores and documents without a word of the query."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + j * j) % 23}" for j in range(k % 6))) for k in range(150)], "doc long, text string")
    posts = retrieval.postings(docs, "doc", "text")
    asked = spark.createDataFrame([(q, f"w{(q * 5 + j) % 23}") for q in range(5) for j in range(3)], "query long, term string")
    vectors = docs.select("doc", F.array(*(F.pmod(F.col("doc") * m, F.lit(5)).cast("float") for m in (1, 2, 3))).alias("embedding"))
    wanted = spark.createDataFrame([(q, [1.0, float(q), -1.0]) for q in range(5)], "query long, vector array<float>")
    hits = retrieval.bm25(posts, asked, retrieval.corpus_totals(docs, "text"))
    every = docs.select("doc").crossJoin(asked.select("query").distinct()).join(hits, ["query", "doc"], "left").select("query", "doc", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
    dense = retrieval.cosine(vectors, wanted).withColumn("score", F.round("score", 9))
    ranks = [retrieval.ranked(s).select("query", "doc", F.col("rank").alias(n)) for s, n in ((every, "b"), (dense, "d"))]
    rows = ranks[0].join(ranks[1], ["query", "doc"]).collect()
    best = {q: sorted(((1 / (60 + r.b) + 1 / (60 + r.d), -r.b, r.doc, r.b, r.d) for r in rows if r.query == q), reverse=True)[:4] for q in range(5)}
    for block in (1000, 2):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        found = retrieval.search(posts, asked, vectors, wanted, 4).collect()
        assert {(r.query, r.doc, r.bm25_rank, r.dense_rank) for r in found} == {(q, x[2], x[3], x[4]) for q, xs in best.items() for x in xs}


def test_bounds_are_refused(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_ORDERED", 2)
    monkeypatch.setattr(readers, "MOST_IN_ENVELOPE", 2)
    rows = spark.range(3).select(F.col("id").alias("doc"), F.lit("x").alias("text"))
    for f in (lambda: retrieval.fingerprint("m", rows, "doc", "doc", "text"), lambda: readers.envelope(rows, "rows")):
        with pytest.raises(ValueError):
            f()
    assert retrieval.large_fingerprint("m", rows, "doc", "text").first() == retrieval.large_fingerprint("m", rows.repartition(3), "doc", "text").first()


def test_stream_adds_nothing_twice(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "nct_id string").write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema("nct_id string").parquet(str(tmp_path / "in"))
        evaluate_stream(stream, lambda rows: rows, str(tmp_path / "out"), str(tmp_path / f"check{k}")).awaitTermination(60)
    assert sorted(r.nct_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
