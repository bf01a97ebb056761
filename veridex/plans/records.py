"""Queries of ingestion, files, judges, logs and streams over the test tables, with their SQL, as in ``registry``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.operators import answers, ingest, judging, latency, patient, retrieval, scoring
from veridex.plans.registry import STOP, E, _eligibility, _t, _verdicts, query
from veridex.schemas import PATIENT
from veridex.sources import readers
from veridex.streaming.incremental import evaluate_stream


def _folder(spark: SparkSession, name: str) -> str:
    return f"{readers.shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw study for each part; each fifth lacks the modules that may be missing."""
    p = _t(spark, sf_dir, "part")
    key, text = F.col("p_partkey"), lambda x: F.lit(x).cast("string")
    some = lambda module: F.when(key % 5 != 0, module)
    place = lambda country: F.struct(country.cast("string").alias("country"), text("c").alias("city"))
    module = F.struct(
        F.struct(F.concat(F.lit("P"), key.cast("string")).alias("nctId"), F.col("p_name").alias("briefTitle"), F.when(key % 2 == 0, F.concat(F.lit("Official "), "p_name")).alias("officialTitle")).alias("identificationModule"),
        F.struct(text("RECRUITING").alias("overallStatus")).alias("statusModule"),
        some(F.struct(text("INTERVENTIONAL").alias("studyType"), F.array(F.lit("PHASE1"), F.lit("PHASE2")).alias("phases"))).alias("designModule"),
        some(F.struct(F.array("p_type").alias("conditions"))).alias("conditionsModule"),
        some(F.struct(F.array(F.struct(text("DRUG").alias("type"), F.col("p_brand").alias("name")), F.struct(text("OTHER").alias("type"), text("x").alias("name"))).alias("interventions"))).alias("armsInterventionsModule"),
        F.struct(_eligibility(p).alias("eligibilityCriteria"), text("ALL").alias("sex"), F.concat(F.col("p_size").cast("string"), F.lit(" Years")).alias("minimumAge"), text(None).alias("maximumAge"), F.lit(False).alias("healthyVolunteers")).alias("eligibilityModule"),
        some(F.struct(F.array(place(F.col("p_type")), place(F.lit("")), place(F.lit(None)), place(F.col("p_brand")), place(F.col("p_type"))).alias("locations"))).alias("contactsLocationsModule"),
    )
    return p.select(module.alias("protocolSection"))


_TRIALS = """SELECT 'P' || p_partkey AS nct_id, p_name AS title, CASE WHEN p_partkey%2=0 THEN 'Official ' || p_name END AS official_title, CASE WHEN p_partkey%5<>0 THEN 'PHASE1/PHASE2' ELSE '' END AS phase,
CASE WHEN p_partkey%5<>0 THEN p_type ELSE '' END AS conditions, CASE WHEN p_partkey%5<>0 THEN p_brand || ',x' ELSE '' END AS interventions, p_size || ' Years' AS min_age,
CASE WHEN p_partkey%5<>0 THEN array_to_string(list_sort(list_distinct([p_type,p_brand])),',') ELSE '' END AS countries, (CASE WHEN p_partkey%4=3 THEN 4 ELSE 2 END)::INT AS n_criteria FROM part"""


def _flat(trials: DataFrame) -> DataFrame:
    joined = lambda c, sep=",": F.array_join(c, sep).alias(c)
    return trials.select("nct_id", "title", "official_title", joined("phase", "/"), joined("conditions"), F.array_join(F.transform("interventions", lambda i: i["name"]), ",").alias("interventions"), "min_age", joined("countries"), "n_criteria")


@query(_TRIALS)
def parsed_studies(spark, sf_dir):
    """Raw studies to parsed trials."""
    return _flat(ingest.parsed_trials(_studies(spark, sf_dir)))


@query(f"{_TRIALS} UNION ALL {_TRIALS}")
def json_files(spark, sf_dir):
    """Studies as files of JSON arrays, read and parsed; then the trials as files of envelopes, written and read again. A file
    has 500 studies; of two names for a file the first that is there counts."""
    out, nth = _folder(spark, "json"), F.floor(F.regexp_extract("nct_id", r"\d+", 0).cast("long") / 500).alias("file")
    raw = _studies(spark, sf_dir).withColumn("nct_id", F.col("protocolSection.identificationModule.nctId"))
    arrays = raw.groupBy(nth).agg(F.collect_list(F.struct("protocolSection")).alias("all"))
    arrays.select("file", F.to_json("all", {"ignoreNullFields": "false"}).alias("value")).write.partitionBy("file").text(f"{out}/studies")
    trials = ingest.parsed_trials(readers.studies(spark, readers.first_existing(spark, f"{out}/none", f"{out}/studies")).select("protocolSection"))
    kept = trials.withColumns({"retrieval_score": F.lit(0.5), "retrieval": F.lit(None).cast("struct<bm25_rank: int, dense_rank: int, bm25_score: double, dense_score: double>")})
    envelopes = kept.groupBy(nth).agg(F.collect_list(F.struct(*kept.columns)).alias("candidates"))
    readers.write_json(envelopes.select(F.lit("50").alias("top_k"), "candidates"), f"{out}/candidates", 1)
    readers.write_json(envelopes.select(F.lit("50").alias("top_k"), "candidates"), f"{out}/candidates", 1)
    return _flat(trials).unionByName(_flat(readers.trials(spark, f"{out}/candidates/*.json")))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for each customer."""
    c, key = _t(spark, sf_dir, "customer"), F.col("c_custkey")
    mutation = lambda gene, change, hot: F.struct(F.lit(gene).alias("gene"), F.lit(change).alias("protein_change"), F.lit("m").alias("variant_class"), F.lit(0.5).alias("tumor_vaf"), F.lit(hot).alias("is_hotspot"), F.lit(1).alias("evidence_score"))
    event = F.struct(F.lit(1).alias("line"), F.lower("c_mktsegment").alias("drug"), F.lit("2025").alias("start_date"), *(F.lit(None).cast("string").alias(n) for n in ("end_date", "best_response", "discontinuation_reason")))
    none = lambda x: F.slice(x, 1, 0)
    mutations, history = F.array(mutation("KRAS", "p.G12C", True), mutation("STK11", "p.G56V", False)), F.array(event)
    given = {
        "patient_id": F.col("c_name"), "diagnosis": F.when(key % 2 == 0, "Lung adenocarcinoma").otherwise(F.concat(F.initcap("c_mktsegment"), F.lit(" cancer"))), "stage": F.lit("IV"), "histology": F.when(key % 3 == 0, "Adenocarcinoma").when(key % 3 == 1, ""),
        "mutations": F.when(key % 4 < 3, mutations).otherwise(none(mutations)), "treatment_history": F.when(key % 5 == 0, history).otherwise(none(history)), "age_years": F.lit(60), "sex": F.lit("FEMALE"), "ecog": F.lit(1),
    }
    fields = ("smoking_status", "brain_metastases", "prior_malignancy", "tmb", "pd_l1_tps", "msi_status")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], PATIENT).schema}
    return c.select(*(x.alias(n) for n, x in given.items()), *(F.lit(None).cast(kinds[n]).alias(n) for n in fields))


@query("""SELECT c_name AS patient_id, concat_ws(' ', CASE WHEN c_custkey%2=0 THEN 'Lung adenocarcinoma' ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' cancer' END, 'stage IV',
CASE WHEN c_custkey%3=0 AND c_custkey%2<>0 THEN 'Adenocarcinoma' END, CASE WHEN c_custkey%2=0 THEN 'non-small cell lung cancer NSCLC' END, CASE WHEN c_custkey%4<3 THEN 'KRAS G12C KRAS G12C mutation STK11' END,
CASE WHEN c_custkey%5=0 THEN 'previously treated advanced metastatic' END) AS search, CASE WHEN c_custkey%5=0 THEN lower(c_mktsegment) ELSE '' END AS drugs FROM customer""")
def search_texts(spark, sf_dir):
    """What each profile is searched by, and the drugs it has had; profiles go through JSON files as users give them."""
    path = f"{_folder(spark, 'patients')}/all"
    people = _people(spark, sf_dir)
    readers.to_json(people).write.text(path)
    read = spark.read.schema(PATIENT).option("mode", "FAILFAST").json(path)
    return read.select("patient_id", patient.query().alias("search"), F.array_join(patient.prior_drugs(F.col("treatment_history")), ",").alias("drugs"))


EXAMPLE = ("a profile", "a criterion", '{"eligible": null}')


@query("""SELECT p_partkey, 'user:a profile' || chr(10) || chr(10) || 'CRITERION' || chr(10) || 'a criterion|assistant:{"eligible": null}|user:' || p_brand || chr(10) || chr(10) || 'CRITERION' || chr(10) || trim(p_name) AS turns,
substr(sha256('rules' || chr(31) || 'a profile' || chr(31) || 'a criterion' || chr(31) || '{"eligible": null}'),1,12) AS version FROM part""")
def judge_messages(spark, sf_dir):
    """What a judge is told about each part, and the version of that text."""
    turns = patient.messages(F.col("p_brand"), F.concat(F.lit(" \n"), "p_name", F.lit("\t ")), EXAMPLE)
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|").alias("turns"), patient.prompt_version("rules", *EXAMPLE).alias("version"))


_CRITERIA = """WITH k AS (SELECT p_partkey, p_partkey%4 AS m, trim(regexp_replace(p_name,'\\s+',' ','g')) AS name, trim(regexp_replace(p_type,'\\s+',' ','g')) AS type, p_brand, p_size FROM part),
c AS (SELECT p_partkey, 'inclusion' AS kind, 0 AS idx, CASE WHEN m=2 THEN name ELSE name || ' and more' END AS text FROM k WHERE m<>0 UNION ALL SELECT p_partkey, 'inclusion', 1, type FROM k WHERE m<>0
UNION ALL SELECT p_partkey, 'exclusion', 0, p_brand FROM k WHERE m IN (0,3) UNION ALL SELECT p_partkey, 'exclusion', 1, 'size ' || p_size FROM k WHERE m IN (0,3)),
j AS (SELECT *, CASE WHEN contains(lower(text),'size') THEN FALSE WHEN contains(lower(text),'more') THEN TRUE END AS e1, CASE WHEN contains(lower(text),'size') THEN 0.95 WHEN contains(lower(text),'more') THEN 0.5 ELSE 0.9 END AS c1 FROM c),
f AS (SELECT *, c1 BETWEEN 0.35 AND 0.75 AS asked FROM j), g AS (SELECT *, CASE WHEN asked THEN FALSE ELSE e1 END AS eligible, CASE WHEN asked THEN 0.8 ELSE c1 END::DOUBLE AS confidence FROM f)"""


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The criteria of all parts, judged by rules, and again by others where the first are unsure; and where answers are."""
    trials = ingest.parsed_trials(_studies(spark, sf_dir))
    pairs = trials.select("nct_id", F.lit("p").alias("patient_id"))
    profile = pairs.select("patient_id").limit(1).withColumn("profile", F.lit("a profile"))
    first = judging.RulesJudge(((("size",), False, 0.95), (("more",), True, 0.5)))
    path = f"{_folder(spark, 'judged')}/answers"
    rows, failed = answers.evaluate(pairs, ingest.criteria_rows(trials), profile, first, judging.RulesJudge((), (False, 0.8), "api", "second"), path)
    return rows.join(failed.select("patient_id", "nct_id").distinct(), ["patient_id", "nct_id"], "left_anti"), path


@query(f"{_CRITERIA} SELECT 'P' || p_partkey AS nct_id, kind, idx, text, eligible, confidence, CASE WHEN asked THEN 'api' ELSE 'local' END AS route, CASE WHEN kind='inclusion' THEN eligible ELSE NOT eligible END AS passes, CASE WHEN asked THEN 'second' ELSE 'rules' END AS model FROM g")
def two_judges(spark, sf_dir):
    """Every criterion of every trial, by the first judge, and by the second where that is unsure."""
    return _judged(spark, sf_dir)[0].select("nct_id", "kind", "idx", "text", "eligible", "confidence", "route", "passes", F.col("final.model").alias("model"))


@query(f"""{_CRITERIA} SELECT 'P' || p_partkey AS nct_id, 'local' AS backend_side, kind AS criterion_kind, idx AS criterion_idx, e1 AS eligible, c1::DOUBLE AS confidence, 1 AS attempts, 0.0::DOUBLE AS temperature, 'v1' AS prompt_version FROM g
UNION ALL SELECT 'P' || p_partkey, 'api', kind, idx, FALSE, 0.8, 1, 0.0, 'v1' FROM g WHERE asked""")
def logged_calls(spark, sf_dir):
    """The log of all calls of both judges, written as batches of JSON lines, one of them twice, and read with its schema."""
    rows, path = _judged(spark, sf_dir)
    made = answers.kept(spark, path, {"patient_id": "string", "nct_id": "string", "pos": "int"})
    log, out = judging.call_log(made.join(rows.select("nct_id", "pos", "kind", "idx"), ["nct_id", "pos"]), "v1", "side"), f"{_folder(spark, 'log')}/log"
    for side in ("local", "api", "local"):
        readers.append_log(log.filter(F.col("side") == side), out, side)
    read = readers.call_log(spark, out).withColumn("side", F.when(F.col("backend") == "api", "api").otherwise("local"))
    return read.select("nct_id", F.col("side").alias("backend_side"), "criterion_kind", "criterion_idx", "eligible", "confidence", "attempts", "temperature", "prompt_version")


@query(f"""WITH w AS (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name || ' . ' || p_type),'[a-z0-9]+'), lambda x: length(x)>1 AND x NOT IN {STOP}) AS words FROM part), x AS (SELECT unnest(CASE WHEN len(words)=0 THEN ['_empty_'] ELSE words END) AS term, p_partkey FROM w)
SELECT term, count(DISTINCT p_partkey) AS df, count(*)::BIGINT AS tf, TRUE AS built_once FROM x GROUP BY 1""")
def kept_index(spark, sf_dir):
    """An index is built for a corpus that has none and read for one that has; a changed corpus has another."""
    docs, folder = _t(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" . ", "p_name", "p_type").alias("text")), _folder(spark, "index")
    built = [retrieval.load_or_build(d, "m", folder, "p_partkey", "text") for d in (docs, docs, docs.filter("p_partkey % 2 = 0"))]
    once = [b for _, b in built] == [True, False, True]
    return built[1][0].groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("tf"), F.lit(once).alias("built_once"))


@query(f"""WITH w AS (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name || CASE WHEN p_partkey%10=0 THEN ' changed' ELSE '' END),'[a-z0-9]+'), lambda x: length(x)>1 AND x NOT IN {STOP}) AS words FROM part WHERE p_partkey%7<>0),
x AS (SELECT unnest(CASE WHEN len(words)=0 THEN ['_empty_'] ELSE words END) AS term, p_partkey FROM w), n AS (SELECT count(*) FILTER (p_partkey%7<>0 AND (p_partkey%2<>0 OR p_partkey%10=0)) AS n FROM part)
SELECT term, count(DISTINCT p_partkey) AS df, count(*)::BIGINT AS tf, n AS n_new FROM x, n GROUP BY term, n""")
def grown_index(spark, sf_dir):
    """An index of half the documents; then some texts change, some documents go and the other half comes. Only new texts
    are tokenised, and the postings are those of the documents as they are."""
    folder, key = _folder(spark, "index"), F.col("p_partkey")
    docs = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    retrieval.grown(docs.filter(key % 2 == 0), folder, "p_partkey", "text", readers.scratch)
    now = docs.filter(key % 7 != 0).withColumn("text", F.when(key % 10 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    posts, n = retrieval.grown(now, folder, "p_partkey", "text", readers.scratch)
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("tf"), F.lit(n).cast("long").alias("n_new"))


@query("SELECT event_id, event_type, value FROM events")
def logged_stream(spark, sf_dir):
    """A stream written to a log of JSON lines, twice over one checkpoint: the second run has nothing to add."""
    out, schema = _folder(spark, "log"), "event_id LONG, event_type STRING, value DOUBLE"
    for _ in range(2):
        readers.log_stream(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"), f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(schema).json(f"{out}/log").select("event_id", "event_type", "value")


@query(f"WITH {E} SELECT o_orderkey, status, score FROM e")
def streamed_evaluations(spark, sf_dir):
    """Trials of a stream, each evaluated once, by two runs over one checkpoint."""
    out, rows = _folder(spark, "evaluated"), _verdicts(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    for _ in range(2):
        trials = spark.readStream.schema("o_orderkey LONG").parquet(f"{sf_dir}/orders.parquet*")
        evaluate_stream(trials, lambda some: scoring.evaluated(some, rows, "o_orderkey", digits=6), f"{out}/trials", f"{out}/checkpoint", "o_orderkey").awaitTermination()
    return spark.read.parquet(f"{out}/trials").select("o_orderkey", "status", "score")


@query("""WITH s AS (SELECT event_type, greatest(round(value*100),0)::BIGINT AS step FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY step) AS nth, count(step) OVER (PARTITION BY event_type) AS n FROM s)
SELECT event_type, count(*) AS n_calls, count(*) FILTER (event_type='error') AS n_failed, sum(step)::BIGINT AS total, min(step) AS least, max(step) AS most, min(step) FILTER (nth*100>=n*50) AS p50, min(step) FILTER (nth*100>=n*95) AS p95 FROM r GROUP BY 1""")
def merged_latencies(spark, sf_dir):
    """Percentiles of a whole log from the counts of its parts."""
    calls, failed = _t(spark, sf_dir, "events"), F.col("event_type") == "error"
    parts = [latency.counted(calls.filter(F.col("user_id") % 3 == k), ["event_type"], "value", failed) for k in range(3)]
    return latency.statistics(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["event_type"])
