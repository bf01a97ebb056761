import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from veridex.functions import text as tx
from veridex.operators import ingest, judging, judgment, patient, retrieval, scoring
from veridex.schemas import PATIENT, STUDY
from veridex.sources import readers


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


PLAIN = '{"eligible": false, "confidence": 0.25, "reasoning": " why ", "patient_feature": "ECOG"}'


def test_a_plain_judgment_is_not_repaired():
    found = judgment.parsed(f"  {PLAIN}\n")
    assert found == {"eligible": False, "confidence": 0.25, "reasoning": "why", "patient_feature": "ECOG", "repaired": False, "parse_error": None}


@pytest.mark.parametrize("around", ["```%s```", "```json\n%s\n``` and ```{}```", "Braces such as } and { aside: %s", "%s {\"eligible\": true}", '{"open": %s'])
def test_a_judgment_is_cut_out(around):
    found = judgment.parsed(around % PLAIN)
    assert (found["eligible"], found["confidence"], found["repaired"]) == (False, 0.25, True)


@pytest.mark.parametrize("value, meaning", [("True", True), ('"Y"', True), ('" MEETS "', True), ("False", False), ('"not_met"', False), ("None", None), ("undetermined", None), ('"n/a"', None), ('""', None)])
@pytest.mark.parametrize("key", ["eligible", "verdict", "met", "answer"])
def test_spellings_of_verdicts(key, value, meaning):
    assert judgment.parsed(f'{{"{key}": {value}, "confidence": 1, "other": [1, 2,],}}')["eligible"] is meaning


@pytest.mark.parametrize("value, share", [('"12%"', 0.12), ('" 0.5 "', 0.5), ("40", 0.4), ("-3", 0.0), ("900", 1.0), ('"150%"', 0.015), ("1.5", 0.015), ("true", 1.0)])
def test_shares_of_confidence(value, share):
    assert judgment.parsed(f'{{"eligible": null, "confidence": {value}}}')["confidence"] == pytest.approx(share)


def test_other_names_count_in_order_and_only_where_needed():
    found = judgment.parsed("{'answer': 'no', 'verdict': 'yes', 'reason': 'a', 'rationale': 'b', 'feature': 'c', 'confidence': 1}")
    assert (found["eligible"], found["reasoning"], found["patient_feature"], found["repaired"]) == (True, "a", "c", True)
    assert judgment.parsed('{"eligible": false, "verdict": true, "confidence": 1, "reasoning": null}')["reasoning"] == ""


@pytest.mark.parametrize("raw", ["", "no braces at all", "{ only an opening", '{"eligible": 1 2, "confidence": 1}', '{"eligible": "likely", "confidence": 1}', '{"eligible": true}', '{"confidence": 1}', '{"eligible": true, "confidence": null}', '{"eligible": true, "confidence": "sure"}', '{"eligible": true, "confidence": NaN}'])
def test_judgment_errors(raw):
    with pytest.raises(judgment.JudgmentError):
        judgment.parsed(raw)
    assert judgment.parsed_or_error(raw) == {"eligible": None, "confidence": 0.0, "reasoning": "", "patient_feature": "none", "repaired": False, "parse_error": judgment.parsed_or_error(raw)["parse_error"]}


def test_parse_udf(spark):
    rows = spark.createDataFrame([('{"eligible": true, "confidence": 0.9}',), ("no",), (None,)], "raw string").select(judgment.parse_judgment("raw").alias("j")).select("j.*").collect()
    assert [r.eligible for r in rows] == [True, None, None] and rows[1].parse_error


def test_answers_as_asked_are_read_without_python_and_alike(spark):
    rng = random.Random(8)
    pick = rng.choice
    texts = [None, "", "no", '{"eligible": true, "confidence": 1, "reasoning": ""} {"b": 2}', '```json\n{"eligible": true, "confidence": 1, "reasoning": ""}\n```']
    for _ in range(1500):
        string = lambda: '"' + "".join(pick(["a", " ", "é", "\\n", '\\"', "\\\\", "{", "}", "```", "\n", "\\u0041", "'", "None"]) for _ in range(pick([0, 0, 1, 3]))) + '"'
        texts.append(
            pick(["", "", " ", "\n"]) + '{"eligible": ' + pick(["true", "false", "null", '"yes"', "True", "1"]) + pick([", ", ",", " ,\n"]) + '"confidence": ' + pick(["0.95", "1", "85", "-2", "100.5", "0", '"80%"', "1e2", "01", "0.12345678901234567", "null"])
            + pick([', "reasoning": ' + string()] * 4 + ["", ', "rationale": "x"']) + pick([', "patient_feature": ' + string(), "", ', "other": 1', ","]) + "}" + pick(["", "", " ", "\n", " so"])
        )
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, raw string")
    found = judgment.answers(rows, "raw", "j")
    assert {r.k: r.j.asDict() for r in found.collect()} == {k: judgment.parsed_or_error(t) for k, t in enumerate(texts)}
    asked = rows.filter(judgment.as_asked(F.col("raw")))
    assert 50 < asked.count() < 1000
    plan = asked.select(judgment.read_as_asked(F.col("raw")).alias("j"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_retries():
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise judging.TransientJudgeError
        return "done"

    assert judging.with_retries(flaky, sleep=pauses.append) == ("done", 3)
    assert 1 <= pauses[0] < 1.25 and 2 <= pauses[1] < 2.5
    with pytest.raises(judging.JudgeError):
        judging.with_retries(lambda: (_ for _ in ()).throw(judging.JudgeError()), sleep=pauses.append)


def test_band_and_routes(spark):
    rows = spark.createDataFrame([(0.34,), (0.35,), (0.75,), (0.76,)], "c double")
    assert [r[0] for r in rows.select(scoring.in_band(F.col("c"))).collect()] == [False, True, True, False]


def test_second_unknown_verdict_wins(spark):
    t = "struct<eligible:boolean,confidence:double>"
    local = spark.createDataFrame([(1, (True, 0.5)), (2, (True, 0.9))], f"k int, local {t}")
    second = spark.createDataFrame([(1, (None, 0.8)), (2, (False, 0.9))], f"k int, api {t}")
    rows = {r.k: r for r in judging.cascade(local, second, ["k"]).collect()}
    assert rows[1].final.eligible is None and rows[1].route == "api"
    assert rows[2].final.eligible is True and rows[2].api is None and rows[2].route == "local"


def verdict_rows(spark, rows):
    v = spark.createDataFrame(rows, "nct_id string, kind string, idx int, eligible boolean, confidence double, weight double")
    v = v.withColumn("passes", scoring.passes(F.col("kind"), F.col("eligible"))).withColumn("kind_order", (F.col("kind") != "inclusion").cast("int"))
    return v.withColumn("pass_confidence", scoring.pass_confidence(F.col("passes"), F.col("confidence"))).withColumn("route", scoring.route(F.col("confidence"), F.lit(False)))


def test_scoring(spark):
    trials = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "nct_id string")
    v = verdict_rows(spark, [
        ("a", "inclusion", 0, True, 0.9, 1.0), ("a", "exclusion", 0, False, 0.9, 1.0), ("b", "inclusion", 0, True, 1.0, 2.0), ("b", "inclusion", 1, None, 0.9, 1.0),
        ("c", "exclusion", 0, True, 0.95, 1.0), ("c", "inclusion", 0, False, 0.5, 1.0),
    ])
    found = {r.nct_id: r for r in scoring.evaluated(trials, v, "nct_id", details=("kind",)).collect()}
    assert (found["a"].status, found["a"].score) == ("eligible", 0.9)
    assert (found["b"].status, found["b"].score, found["b"].n_unknown) == ("unresolved", 0.8333, 1)
    assert found["c"].status == "ineligible" and len(found["c"].blocking) == 1
    assert (found["d"].status, found["d"].score, found["d"].note) == ("unresolved", 0.0, "no criteria parsed")


def test_rank_order(spark):
    """By status, then score, then retrieval score, then key; nulls count as 0, a status of another name comes last."""
    statuses = ("eligible", "unresolved", "ineligible", "other")
    rows = [(f"k{n:02}", statuses[n * 7 % 4], (None, 0.0, 0.25, 0.5)[n * 5 % 4], (None, 0.0, 0.1)[n % 3]) for n in range(40)]
    df = spark.createDataFrame(rows, "k string, s string, x double, r double")
    want = sorted(rows, key=lambda r: (statuses.index(r[1]), -(r[2] or 0), -(r[3] or 0), r[0]))
    assert [tuple(r) for r in df.orderBy(*scoring.rank_order(F.col("s"), F.col("x"), F.col("r"), F.col("k"))).collect()] == want


def test_fused_lists_are_sums_over_the_lists_that_have_a_document(spark):
    lists = [["d", "a", "f"], ["a"], ["b", "f", "c", "a"]]
    tables = [spark.createDataFrame([(7, d, n) for n, d in enumerate(x, 1)] + [(8, "only", 5)], "query int, doc string, rank int") for x in lists]
    found = {(r.query, r.doc): r.rrf for r in retrieval.fused(tables, 10).collect()}
    want = {(7, d): pytest.approx(sum(1 / (11 + x.index(d)) for x in lists if d in x)) for d in "abcdf"}
    assert found == want | {(8, "only"): pytest.approx(3 / 15)}


def test_index_is_built_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "lung cancer"), (2, "")], "doc long, text string")
    folder = f"file://{tmp_path}/index"
    assert [retrieval.load_or_build(d, "m", folder, "doc", "text")[1] for d in (docs, docs, docs.filter("doc = 1"))] == [True, False, True]


TEXT = "About\nInclusion Criteria:\n* Aged at least 18 years\n* ECOG performance status of 0 to 1\n\nExclusion criteria:\n* Prior treatment with a KRAS  inhibitor\n* brain metastases"


def test_criteria(spark):
    found = one(spark, tx.criteria(F.col("t")), t=TEXT)
    assert [(c.kind, c.idx, c.text) for c in found] == [
        ("inclusion", 0, "Aged at least 18 years"), ("inclusion", 1, "ECOG performance status of 0 to 1"), ("exclusion", 0, "Prior treatment with a KRAS inhibitor"), ("exclusion", 1, "brain metastases"),
    ]
    assert found[0].features.min_age_years == 18 and found[1].features.ecog_max == 1
    assert found[2].features.biomarkers == ["KRAS"] and found[2].features.prior_therapy_relevant and found[3].features.mentions_brain_mets
    assert one(spark, tx.criteria(F.col("t")), t="") == [] and one(spark, F.size(tx.criteria(F.col("t"))), t="one\n\ntwo") == 2


def test_parsed_trials(spark):
    study = {"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "T"}, "eligibilityModule": {"eligibilityCriteria": TEXT}, "contactsLocationsModule": {"locations": [{"country": "B"}, {"country": "A"}, {"country": None}, {"country": "B"}]}}}
    rows = spark.read.schema(STUDY).json(spark.sparkContext.parallelize([json.dumps(study), "{}"]))
    t = {r.nct_id: r for r in ingest.parsed_trials(rows).collect()}
    assert t["N1"].countries == ["A", "B"] and t["N1"].n_criteria == 4 and t["N1"].phase == []
    assert t[None].n_criteria == 0


PATIENT_ROW = {
    "patient_id": "p", "diagnosis": "Lung adenocarcinoma", "stage": "IV", "age_years": 63, "sex": "Female", "ecog": 1, "smoking_status": "former", "histology": None, "brain_metastases": None, "prior_malignancy": None,
    "mutations": [{"gene": "KRAS", "protein_change": "p.G12C", "is_hotspot": True}, {"gene": "STK11", "protein_change": "p.F354L", "is_hotspot": False}], "tmb": 15.0, "pd_l1_tps": None, "msi_status": "MSS",
    "treatment_history": [{"line": 2, "drug": "Sotorasib", "start_date": "2026-01", "end_date": None, "best_response": "PD"}, {"line": 1, "drug": "carboplatin", "start_date": "2025-01", "end_date": "2025-06", "best_response": "PR"}],
}


def test_patient(spark):
    p = spark.read.schema(PATIENT).json(spark.sparkContext.parallelize([json.dumps(PATIENT_ROW)]))
    h, m = F.col("treatment_history"), F.col("mutations")
    r = p.select(
        patient.query().alias("q"), patient.summary(date(2026, 9, 30)).alias("s"), patient.current_line(h).alias("n"), patient.prior_response_to(h, "SOTO").alias("b"), patient.prior_response_to(h, "x").alias("none"),
        patient.has_mutation(m, "kras", "g12c").alias("has"), patient.has_mutation(m, "kras", "g12d").alias("hasnt"),
    ).first()
    assert r.q == "Lung adenocarcinoma stage IV non-small cell lung cancer NSCLC KRAS G12C KRAS G12C mutation STK11 previously treated advanced metastatic"
    assert (r.n, r.b, r.none, r.has, r.hasnt) == (3, "PD", None, True, False)
    assert "TMB 15 mut/Mb; PD-L1 TPS not recorded; MSI: MSS" in r.s and r.s.index("Line 1: carboplatin") < r.s.index("Line 2: Sotorasib, 2026-01 to ongoing, best response PD")


def test_resume_treats_null_as_equal(spark):
    t = spark.createDataFrame([("a",), (None,), ("b",), ("b",)], "k string")
    assert [r.k for r in judging.still_to_do(t, spark.createDataFrame([("a",), (None,)], "k string"), "k").collect()] == ["b", "b"]


def test_judged_and_logged(spark):
    rows = spark.createDataFrame([("p", "n", "inclusion", 0, "KRAS G12C mutation"), ("p", "n", "exclusion", 0, "other")], "patient_id string, nct_id string, kind string, idx int, text string")
    judge = judging.RulesJudge(((("kras", "mutation"), True, 0.97),))
    done = judging.cascade(judging.judged(rows.withColumn("profile", F.lit("x")), judge, "profile", "text", "local"), None, [])
    found = {r.text: r for r in done.collect()}
    assert found["KRAS G12C mutation"].final.eligible is True and found["other"].final.eligible is None
    assert judging.call_log(done, "v").count() == 2


def test_study_pages():
    pages = {None: {"studies": [{"a": 1}, {"a": 2}], "nextPageToken": "t"}, "t": {"studies": [{"a": 3}]}}
    get = lambda url: pages["t" if "pageToken=t" in url else None]
    assert [s["a"] for s in readers.study_pages("http://x", "c", "COMPLETED", ["f"], 10, get, 0)] == [1, 2, 3]
    assert len(list(readers.study_pages("http://x", "c", "COMPLETED", [], 2, get, 0))) == 2
    with pytest.raises(ValueError):
        list(readers.study_pages("http://x", "c", "OTHER", [], 2, get, 0))


def test_example_and_envelope(spark, tmp_path):
    p = readers.patients(spark, "example")
    assert p.select(patient.query()).first()[0].endswith("KRAS G12C KRAS G12C mutation STK11 KEAP1 RBM10 previously treated advanced metastatic")
    assert '"prior_malignancy":null' in readers.to_json(p).first().json
    assert readers.envelope(p.select("patient_id"), "rows", top_k="5").first().asDict(True) == {"top_k": "5", "rows": [{"patient_id": "TCGA-05-4418-derived"}]}
    assert readers.first_existing(spark, f"file://{tmp_path}/no", f"file://{tmp_path}") == f"file://{tmp_path}"


def test_breakdown(spark):
    study = {"protocolSection": {"eligibilityModule": {"eligibilityCriteria": TEXT}}}
    trials = ingest.parsed_trials(spark.read.schema(STUDY).json(spark.sparkContext.parallelize([json.dumps(study)])))
    r = ingest.breakdown(trials).first()
    assert (r.n_inclusion, r.n_exclusion, r.genes) == (2, 2, ["KRAS"]) and ingest.totals(trials).first().n_criteria == 4


def test_server_and_resume():
    assert judging.server_url(None, "127.0.0.1:1/") == "http://127.0.0.1:1" and judging.server_url("https://x/", None) == "https://x"
    judging.same_run({"patient_id": 1}, {"patient_id": 1})
    with pytest.raises(ValueError):
        judging.same_run({"patient_id": 1, "as_of": "a"}, {"patient_id": 1, "as_of": "b"})
