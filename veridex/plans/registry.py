"""Every query over the test tables with its oracle SQL, by name.

An order stands for a trial and its line items for criteria: the line status is the kind, the return flag the verdict
(A true, R false, N unknown), ten times the discount the confidence, a quantity from 25 on a biomarker, the total price
the retrieval score. All queries run over whole tables; searches take every row whose id is divisible by 50 as a query, but
``bm25_topk`` takes all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.functions import text as tx
from veridex.operators import answers, ingest, judging, judgment, patient, report, retrieval, scoring
from veridex.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.when(F.col("l_linestatus") == "O", "inclusion").otherwise("exclusion").alias("kind"),
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("eligible"), F.round(F.col("l_discount") * 10, 1).alias("confidence"),
        scoring.weight(F.col("l_quantity") >= 25).alias("weight"), F.round(F.col("l_tax") * 10, 1).alias("second"), "l_extendedprice",
    )
    li = li.withColumn("passes", scoring.passes(F.col("kind"), F.col("eligible")))
    return li.withColumn("pass_confidence", scoring.pass_confidence(F.col("passes"), F.col("confidence"))).withColumn("route", scoring.route(F.col("confidence"), F.col("second") >= 0.3))


V = """v0 AS (SELECT l_orderkey, l_partkey, CASE WHEN l_linestatus='O' THEN 'inclusion' ELSE 'exclusion' END AS kind,
  CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE END AS eligible, round(l_discount*10,1) AS confidence,
  CASE WHEN l_quantity>=25 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, round(l_tax*10,1) AS second, l_extendedprice FROM lineitem),
v1 AS (SELECT *, CASE WHEN kind='inclusion' THEN eligible ELSE NOT eligible END AS passes FROM v0),
v AS (SELECT *, CASE WHEN passes IS NULL THEN 0.5::DOUBLE WHEN passes THEN confidence ELSE 1.0::DOUBLE-confidence END AS pass_confidence,
  CASE WHEN NOT (confidence BETWEEN 0.35 AND 0.75) THEN 'local' WHEN second>=0.3 THEN 'api' ELSE 'api_unavailable' END AS route FROM v1)"""
E = f"""{V}, s AS (SELECT l_orderkey, bool_or(coalesce(NOT passes AND confidence>0.5,FALSE)) AS blocked, bool_and(coalesce(passes AND confidence>0.5,FALSE)) AS all_pass,
  sum(weight*pass_confidence)/sum(weight) AS raw, count(*) FILTER (passes) AS n_pass, count(*) FILTER (NOT passes) AS n_fail, count(*) FILTER (passes IS NULL) AS n_unknown,
  count(*) AS n_criteria, count(*) FILTER (route='api') AS n_routed_api, count(*) FILTER (route='api_unavailable') AS n_api_unavailable FROM v GROUP BY 1),
e AS (SELECT o_orderkey, o_custkey, o_totalprice AS retrieval_score, CASE WHEN blocked THEN 'ineligible' WHEN all_pass THEN 'eligible' ELSE 'unresolved' END AS status,
  coalesce(round(raw,6),0.0) AS score, coalesce(n_pass,0) AS n_pass, coalesce(n_fail,0) AS n_fail, coalesce(n_unknown,0) AS n_unknown, coalesce(n_criteria,0) AS n_criteria,
  coalesce(n_routed_api,0) AS n_routed_api, coalesce(n_api_unavailable,0) AS n_api_unavailable, CASE WHEN n_criteria IS NULL THEN 'no criteria parsed' END AS note
  FROM orders LEFT JOIN s ON o_orderkey=l_orderkey)"""
PLACE = "CASE status WHEN 'eligible' THEN 0 WHEN 'unresolved' THEN 1 WHEN 'ineligible' THEN 2 ELSE 9 END"


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("retrieval_score"))
    return scoring.evaluated(orders, _verdicts(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", digits=6)


@query(f"WITH {E} SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {PLACE}, score DESC, retrieval_score DESC, o_orderkey) AS rank FROM e")
def trial_rank(spark, sf_dir):
    """Status, score and rank of every trial within its patient."""
    return report.ranked(_evaluated(spark, sf_dir), "o_orderkey", "o_custkey").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {E} SELECT o_orderkey, status, score, retrieval_score FROM e ORDER BY {PLACE}, score DESC, retrieval_score DESC, o_orderkey LIMIT 50")
def report_top(spark, sf_dir):
    """The report's best trials over all, by TakeOrderedAndProject."""
    c = F.col
    return _evaluated(spark, sf_dir).orderBy(*scoring.rank_order(c("status"), c("score"), c("retrieval_score"), c("o_orderkey"))).select("o_orderkey", "status", "score", "retrieval_score").limit(50)


@query(f"WITH {V} SELECT l_orderkey, l_partkey, kind, eligible, confidence, weight, passes, round(pass_confidence,6) AS pass_confidence, route FROM v")
def criterion_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("l_orderkey", "l_partkey", "kind", "eligible", "confidence", "weight", "passes", F.round("pass_confidence", 6).alias("pass_confidence"), "route")


def _cascade(spark, sf_dir):
    """Two judges: the second one answers with half its own verdicts unknown."""
    side = lambda v, c, t: F.struct(v.cast("boolean").alias("eligible"), c.cast("double").alias("confidence"), F.lit("r").alias("reasoning"), t.alias("latency_s"), F.lit(7).alias("input_tokens"), F.lit(None).cast("int").alias("output_tokens"), F.when(F.col("l_partkey") % 11 == 0, "bad").alias("parse_error"))
    v = _verdicts(spark, sf_dir)
    first = side(F.col("eligible"), F.col("confidence"), F.col("l_extendedprice") / 1000)
    other = side(F.when(F.col("l_partkey") % 2 == 0, F.lit(True)), F.lit(0.9), F.lit(1.5))
    local = v.select("l_orderkey", "l_partkey", "kind", first.alias("local"), F.when(F.col("second") >= 0.3, other).alias("offered"))
    asked = local.withColumn("api", F.when(scoring.in_band(F.col("local.confidence")), F.col("offered"))).drop("offered")
    return judging.settled(asked)


C = f"""{V}, c AS (SELECT *, confidence BETWEEN 0.35 AND 0.75 AND second>=0.3 AS asked, CASE WHEN l_partkey%2=0 THEN TRUE END AS api_eligible,
  CASE WHEN l_partkey%11=0 THEN 'bad' END AS err, l_extendedprice/1000 AS lat FROM v)"""


@query(f"WITH {C} SELECT l_orderkey, l_partkey, route, CASE WHEN asked THEN api_eligible ELSE eligible END AS eligible, CASE WHEN asked THEN 0.9::DOUBLE ELSE confidence END AS confidence FROM c")
def routing_cascade(spark, sf_dir):
    return _cascade(spark, sf_dir).select("l_orderkey", "l_partkey", "route", F.col("final.eligible").alias("eligible"), F.col("final.confidence").alias("confidence"))


@query(f"""WITH {E}, c AS (SELECT *, confidence BETWEEN 0.35 AND 0.75 AND second>=0.3 AS asked, CASE WHEN l_partkey%2=0 THEN TRUE END AS api_eligible,
  CASE WHEN l_partkey%11=0 THEN 'bad' END AS err, l_extendedprice/1000 AS lat FROM v)
SELECT t.*, u.* FROM (SELECT count(*) AS n_trials, count(*) FILTER (status='eligible') AS n_eligible, count(*) FILTER (status='unresolved') AS n_unresolved, count(*) FILTER (status='ineligible') AS n_ineligible FROM e) t,
(SELECT count(*) AS n_criteria, count(*) FILTER ((CASE WHEN asked THEN api_eligible ELSE eligible END) IS NULL) AS n_unknown_criteria, round(avg(lat),3) AS mean_local_latency_s,
 round(avg(lat+CASE WHEN asked THEN 1.5 ELSE 0.0 END),3) AS mean_criterion_time_s, round(count(*) FILTER (route<>'local')/count(*),4) AS routing_band_rate, count(*) FILTER (route='api') AS n_routed_api,
 round(count(*) FILTER (route='api')/count(*),4) AS api_routing_rate, count(*) FILTER (route='api_unavailable') AS n_api_unavailable,
 count(*) FILTER (asked AND api_eligible IS DISTINCT FROM eligible) AS n_api_flipped, count(*) FILTER (err IS NOT NULL) AS n_parse_errors, (7*count(*))::BIGINT AS input_tokens_local,
 (7*count(*) FILTER (asked))::BIGINT AS input_tokens_api, 0::BIGINT AS output_tokens_local, 0::BIGINT AS output_tokens_api FROM c) u""")
def run_summary(spark, sf_dir):
    rows = _cascade(spark, sf_dir)
    return scoring.run_summary(_evaluated(spark, sf_dir), rows.withColumn("eligible", F.col("final.eligible")))


@query(f"WITH {E} SELECT s.status, count(e.status) AS n FROM (VALUES ('eligible'),('unresolved'),('ineligible')) s(status) LEFT JOIN e USING (status) GROUP BY 1")
def status_histogram(spark, sf_dir):
    """Counts by status; a status without trials has 0."""
    names = F.explode(F.array(*map(F.lit, scoring.STATUSES))).alias("status")
    every = spark.range(1).select(names)
    counts = _evaluated(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"WITH {V} SELECT l_orderkey, count(*) AS n, string_agg(kind || '#' || l_partkey, ',' ORDER BY kind DESC, l_partkey) AS blocking FROM v WHERE NOT passes AND confidence>0.5 GROUP BY 1")
def blocking_list(spark, sf_dir):
    """Blockers of each trial in order: inclusion first, then by number."""
    v = _verdicts(spark, sf_dir).filter(~F.col("passes") & (F.col("confidence") > scoring.DECISIVE))
    key = F.struct((F.col("kind") != "inclusion").alias("k"), "l_partkey", F.concat_ws("#", "kind", "l_partkey").alias("x"))
    found = v.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(key)).alias("b"))
    return found.select("l_orderkey", "n", F.array_join(F.transform("b", lambda x: x["x"]), ",").alias("blocking"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey IS NOT DISTINCT FROM o_orderkey AND l_quantity>=45)")
def resume_todo(spark, sf_dir):
    done = _t(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return judging.still_to_do(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus='F' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice>=100000")
def append_results(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return judging.resumed(o.filter("o_orderstatus = 'F'"), o.filter("o_totalprice >= 100000")).drop("o_totalprice")


STOP = "(" + ",".join(f"'{w}'" for w in tx.STOPWORDS) + ")"
W = f"w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text),'[a-z0-9]+'), lambda x: length(x)>1 AND x NOT IN {STOP}) AS words FROM documents)"


@query(f"WITH {W} SELECT doc_id, len(words)::BIGINT AS n, array_to_string(words,' ') AS tokens FROM w")
def tokenize_terms(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("tokens"))


P = f"""{W}, x AS (SELECT doc_id, unnest(CASE WHEN len(words)=0 THEN ['_empty_'] ELSE words END) AS term, greatest(len(words),1) AS dl FROM w),
p AS (SELECT doc_id, term, dl, count(*) AS tf FROM x GROUP BY ALL), r AS (SELECT term, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM p),
i0 AS (SELECT term, df, ln(n-df+0.5)-ln(df+0.5) AS raw FROM r, n), i AS (SELECT term, df, CASE WHEN raw<0 THEN 0.25*(SELECT avg(raw) FROM i0) ELSE raw END AS idf FROM i0)"""


def _postings(spark, sf_dir, by_document=False):
    """Postings, written once, and the corpus totals, counted while they are written."""
    posts, n, length = retrieval.indexed(_t(spark, sf_dir, "documents"), "doc_id", "text", readers.scratch, by_document)
    return posts, spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(length / max(n, 1)).alias("avgdl"))


@query(f"WITH {P} SELECT term, df, round(idf,6) AS idf FROM i")
def bm25_corpus_stats(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return retrieval.weighed(retrieval.document_frequencies(docs, "text"), docs.agg(F.count("*").alias("n"))).select("term", "df", F.round("idf", 6).alias("idf"))


def _words_of(items):
    """Search words of benchmark items stand for patients' queries."""
    return items.select(F.col("item_id").alias("query"), F.explode(tx.tokens(F.col("text"))).alias("term"))


def _queries(spark, sf_dir):
    return _words_of(_t(spark, sf_dir, "benchmark").filter("item_id % 50 = 0"))


Q = f"q AS (SELECT item_id AS query, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text),'[a-z0-9]+'), lambda x: length(x)>1 AND x NOT IN {STOP})) AS term FROM benchmark WHERE item_id%50=0) GROUP BY ALL)"
BM = f"""{P}, {Q}, a AS (SELECT avg(dl) AS avgdl FROM (SELECT DISTINCT doc_id, dl FROM p)),
b AS (SELECT query, doc_id AS doc, sum(times*idf*tf*2.5/(tf+1.5*(0.25+0.75*dl/avgdl))) AS score FROM p JOIN q USING (term) JOIN i USING (term), a GROUP BY ALL)"""

EVERY = BM.replace(Q, Q.replace(" WHERE item_id%50=0", ""))


@query(f"WITH {EVERY} SELECT query, doc, round(score,6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score,9) DESC, doc) AS rank FROM b) WHERE rank<=10")
def bm25_topk(spark, sf_dir):
    """The best ten documents of every benchmark item."""
    posts, totals = _postings(spark, sf_dir, by_document=True)
    asked = readers.scratch(_words_of(_t(spark, sf_dir, "benchmark")), "words")
    top = retrieval.bm25_of_documents(posts, asked, totals, 10)
    return top.select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _vectors(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    return v, v.filter("doc % 50 = 0").select(F.col("doc").alias("query"), F.col("embedding").alias("vector"))


D = "d AS (SELECT q.vec_id AS query, e.vec_id AS doc, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id%50=0)"


@query(f"WITH {D} SELECT query, doc, round(score,6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score,9) DESC, doc) AS rank FROM d) WHERE rank<=10")
def dense_topk(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    top = reduce(DataFrame.union, (retrieval.cosine_best(vectors, some, 10) for some in retrieval.blocks(asked)))
    return top.select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {BM}, {D}, lex AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score,9) DESC, doc) AS r FROM b),
den AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score,9) DESC, doc) AS r FROM d), u AS (SELECT * FROM lex UNION ALL SELECT * FROM den)
SELECT query, doc, round(sum(1.0::DOUBLE/(60+r)),9) AS rrf FROM u GROUP BY ALL""")
def rrf_hybrid(spark, sf_dir):
    """Whole lists that rank different documents, fused. Only queries with two lists have something to add up."""
    posts, totals = _postings(spark, sf_dir)
    words = readers.scratch(_queries(spark, sf_dir), "words")
    lexical = retrieval.bm25(posts, words, totals).withColumn("s", F.round("score", 9))
    vectors, asked = _vectors(spark, sf_dir)
    lexically = words.select("query").distinct()
    two, one = retrieval.cosine_reciprocal(vectors, asked.join(lexically, "query", "left_semi")), retrieval.cosine_reciprocal(vectors, asked.join(lexically, "query", "left_anti"), places=9)
    both = retrieval.fused([retrieval.ranked(lexical, "s")]).unionByName(two).groupBy("query", "doc").agg(F.sum("rrf").alias("rrf"))
    return both.select("query", "doc", F.round("rrf", 9).alias("rrf")).unionByName(one)


@query(f"""WITH {BM}, {D}, ids AS (SELECT DISTINCT doc_id AS doc FROM p SEMI JOIN embeddings ON vec_id=doc_id), qs AS (SELECT DISTINCT query FROM q SEMI JOIN d USING (query)), al AS (SELECT query, doc, coalesce(score,0.0) AS score FROM (SELECT * FROM ids, qs) LEFT JOIN b USING (query, doc)),
lex AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score,9) DESC, doc) AS br FROM al), den AS (SELECT query, doc, d.score AS ds, row_number() OVER (PARTITION BY query ORDER BY round(d.score,9) DESC, doc) AS dr FROM d SEMI JOIN ids USING (doc)),
h AS (SELECT query, doc, br, dr, score, ds, 1.0::DOUBLE/(60+br)+1.0::DOUBLE/(60+dr) AS s FROM lex JOIN den USING (query, doc))
SELECT query, doc, round(s,6) AS retrieval_score, br::INT AS bm25_rank, dr::INT AS dense_rank, round(score,4) AS bm25_score, round(ds,4) AS dense_score FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, br) <= 10""")
def hybrid_search(spark, sf_dir):
    """The best ten of each query by both rankings of the whole corpus, as candidates."""
    from veridex.cli import decorated

    vectors, asked = _vectors(spark, sf_dir)
    posts, totals = _postings(spark, sf_dir)
    found = retrieval.search(posts, _queries(spark, sf_dir), vectors, asked, 10, totals)
    return found.select("query", "doc", *decorated()).select("query", "doc", "retrieval_score", "retrieval.*")


@query("SELECT p_partkey, array_to_string(list_filter([p_name, CASE WHEN p_size>25 THEN p_brand ELSE '' END, p_type, p_brand], lambda x: x IS NOT NULL AND x<>''),' . ') AS doc FROM part")
def doc_compose(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", tx.document(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(""), F.array("p_type"), F.array("p_brand")).alias("doc"))


@query(r"SELECT doc_id, idx-1 AS idx, trim(regexp_replace(line,'[ \t]+',' ','g')) AS line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l,1) AS idx FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def section_split(spark, sf_dir):
    """Lines of a text with their numbers."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "x"))
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), F.trim(F.regexp_replace("x", "[ \t]+", " ")).alias("line"))


GENES = ("KRAS", "EGFR", "BRAF", "ALK", "ROS1", "MET", "RET", "HER2", "ERBB2", "STK11")
_list = lambda words: "[" + ",".join(f"'{w}'" for w in words) + "]"


def _nth(words, n: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), n.cast("int"))


@query(f"""WITH k AS (SELECT *, p_partkey%8 AS m, {_list(GENES)}[p_partkey%10+1] AS g, {_list(GENES)}[(p_partkey*7+3)%10+1] AS g2 FROM part)
SELECT p_partkey, CASE WHEN m IN (0,3) THEN g WHEN m=5 THEN array_to_string(list_sort(list_distinct([g,g2])),',') ELSE '' END AS biomarkers,
CASE m WHEN 0 THEN 'G' || p_size || 'C' WHEN 5 THEN 'AMPLIFICATION,EXON ' || p_size || ' DELETION' ELSE '' END AS mutations,
(CASE WHEN m=2 THEN p_size END)::INT AS min_age_years, m=4 AS brain, m=3 AS prior, (CASE WHEN m IN (1,7) THEN p_size%5 END)::INT AS ecog_max FROM k""")
def feature_extract(spark, sf_dir):
    """Criteria that say one thing each, in a part's own terms: what the features find is what was said."""
    p, key, size = _t(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size").cast("string")
    gene, other, grade = _nth(GENES, key % 10), _nth(GENES, (key * 7 + 3) % 10), (F.col("p_size") % 5).cast("string")
    said = (
        ("Histologically confirmed NSCLC with ", gene, " g", size, "c mutation"), ("ECOG performance status of 0 to ", grade), ("Patients aged at least ", size, " years"), ("Previously on systemic treatment with a ", gene, " inhibitor"), ("No known Brain  metastases",),
        (gene, " Exon ", size, " deletion; ", other, " amplification allowed"), ("Adequate organ function",), ("ecog <= ", grade),
    )
    text = F.lit("")
    for n, parts in enumerate(said):
        text = F.when(key % 8 == n, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))).otherwise(text)
    f = p.select("p_partkey", tx.features(text).alias("f"))
    return f.select("p_partkey", F.coalesce(F.array_join("f.biomarkers", ","), F.lit("")).alias("biomarkers"), F.coalesce(F.array_join("f.mutations", ","), F.lit("")).alias("mutations"), "f.min_age_years", F.coalesce("f.mentions_brain_mets", F.lit(False)).alias("brain"), F.coalesce("f.prior_therapy_relevant", F.lit(False)).alias("prior"), "f.ecog_max")


@query(r"SELECT doc_id, trim(regexp_replace(text,'[ \t\n\r]+',' ','g')) AS clean, replace(replace(text,'|','\|'),chr(10),' ') AS escaped FROM documents")
def clean_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.collapsed(F.col("text")).alias("clean"), tx.markdown_escaped(F.col("text")).alias("escaped"))


@query("SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


VERDICTS = (*judgment.TRUE_WORDS, *judgment.FALSE_WORDS, *judgment.NULL_WORDS, "perhaps", "ineligible?")
_true, _known = len(judgment.TRUE_WORDS), len(VERDICTS) - 2
_false = _true + len(judgment.FALSE_WORDS)


@query(f"SELECT event_id, CASE WHEN w<{_true} THEN TRUE WHEN w<{_false} THEN FALSE END AS eligible, w<{_known} AS known FROM (SELECT event_id, event_id%{len(VERDICTS)} AS w FROM events)")
def coerce_verdict(spark, sf_dir):
    """Every word for a verdict and two for none, in either case and with blanks around."""
    word = _nth(VERDICTS, F.col("event_id") % len(VERDICTS))
    word = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("  "), F.upper(word), F.lit(" "))).otherwise(word)
    return _t(spark, sf_dir, "events").select("event_id", judgment.verdict(word).alias("eligible"), judgment.is_verdict(word).alias("known"))


@query("""SELECT event_id, round(CASE m WHEN 0 THEN k/100.0 WHEN 1 THEN k/100.0 WHEN 2 THEN CASE WHEN k>1 THEN least(k/100.0,1.0) ELSE k END WHEN 3 THEN (k+101)/10000.0 ELSE 0.0 END,6)::DOUBLE AS confidence
FROM (SELECT event_id, event_id%101 AS k, user_id%6 AS m FROM events) WHERE m<5""")
def coerce_confidence(spark, sf_dir):
    """A share as a percentage, a fraction, a number of hundredths; a percentage above 100, which counts as hundredths of one; below nothing; and a word."""
    k, m = F.col("event_id") % 101, F.col("user_id") % 6
    n = k.cast("string")
    said = F.when(m == 0, F.concat(F.lit(" "), n, F.lit(" %"))).when(m == 1, (k / 100).cast("string")).when(m == 2, n).when(m == 3, F.concat((k + 101).cast("string"), F.lit("%"))).when(m == 4, F.concat(F.lit("-"), (k + 1).cast("string"))).otherwise("high")
    return _t(spark, sf_dir, "events").select("event_id", F.round(judgment.confidence(said), 6).alias("confidence")).filter("confidence is not null")


@query("""SELECT event_id, CASE user_id%5 WHEN 0 THEN '{"a": true, "b": [' || event_id || ',2]}' WHEN 1 THEN '{"e": null, "c": null, "k": ' || event_id || '}' WHEN 2 THEN '{"e": false, "k": ' || event_id || '}'
WHEN 3 THEN '{"x": null , "k": ' || event_id || '}' ELSE '{"ok": ' || event_id || '}' END AS fixed FROM events""")
def repair_json(spark, sf_dir):
    """Objects with commas too many and with words of another language, and one that is right."""
    broken = (('{"a": True, "b": [', ",2, ],}"), ('{"e": unknown, "c": None, "k": ', "}"), ('{"e": False, "k": ', "}"), ('{"x": Undetermined , "k": ', ",\n}"), ('{"ok": ', "}"))
    text = F.lit("")
    for n, (a, b) in enumerate(broken):
        text = F.when(F.col("user_id") % 5 == n, F.concat(F.lit(a), F.col("event_id").cast("string"), F.lit(b))).otherwise(text)
    return _t(spark, sf_dir, "events").select("event_id", judgment.repaired_json(text).alias("fixed"))


@query("""SELECT o_custkey, bool_or(upper(o_orderpriority)='1-URGENT' AND o_orderstatus='F') AS has_member, arg_max(o_orderpriority, o_orderkey) FILTER (contains(lower(o_orderpriority),'high')) AS last_match,
count(*)+1 AS next_line FROM orders GROUP BY 1""")
def profile_functions(spark, sf_dir):
    """Membership, last match and next line over each customer's orders as a history."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("h"))
    history = F.transform("h", lambda x, i: F.struct((i + 1).alias("line"), x["o_orderpriority"].alias("drug"), x["o_orderpriority"].alias("best_response")))
    muts = F.transform("h", lambda x: F.struct(x["o_orderpriority"].alias("gene"), x["o_orderstatus"].alias("protein_change")))
    o = o.select("o_custkey", history.alias("history"), muts.alias("muts"))
    return o.select("o_custkey", patient.has_mutation(F.col("muts"), "1-urgent", "p.F").alias("has_member"), patient.prior_response_to(F.col("history"), "HIGH").alias("last_match"), patient.current_line(F.col("history")).cast("long").alias("next_line"))


@query("SELECT r_regionkey, p_partkey, r_name || ' / ' || p_brand AS pair FROM region, part")
def cross_patient(spark, sf_dir):
    """One small side (patients) against every criterion; the small side is a table of fixed size."""
    return _t(spark, sf_dir, "part").crossJoin(F.broadcast(_t(spark, sf_dir, "region"))).select("r_regionkey", "p_partkey", F.concat_ws(" / ", "r_name", "p_brand").alias("pair"))


@query(f"""WITH {V}, x AS (SELECT r_regionkey, v.*, CASE WHEN (l_partkey+r_regionkey)%3=0 THEN NULL ELSE passes END AS p FROM v, region),
y AS (SELECT *, CASE WHEN p IS NULL THEN 0.5::DOUBLE WHEN p THEN confidence ELSE 1.0::DOUBLE-confidence END AS pc FROM x),
z AS (SELECT r_regionkey, l_orderkey, bool_or(coalesce(NOT p AND confidence>0.5,FALSE)) AS blocked, bool_and(coalesce(p AND confidence>0.5,FALSE)) AS all_pass, sum(weight*pc)/sum(weight) AS raw, count(*) AS n_criteria, count(*) FILTER (p IS NULL) AS n_unknown FROM y GROUP BY 1, 2)
SELECT r.r_regionkey, o_orderkey, CASE WHEN blocked THEN 'ineligible' WHEN all_pass THEN 'eligible' ELSE 'unresolved' END AS status, coalesce(round(raw,6),0.0) AS score, coalesce(n_criteria,0) AS n_criteria, coalesce(n_unknown,0) AS n_unknown
FROM orders CROSS JOIN region r LEFT JOIN z ON z.l_orderkey=o_orderkey AND z.r_regionkey=r.r_regionkey""")
def several_patients(spark, sf_dir):
    """Several patients against all trials: evaluations are by patient and trial."""
    people = _t(spark, sf_dir, "region").select("r_regionkey")
    pairs = _t(spark, sf_dir, "orders").select("o_orderkey").crossJoin(F.broadcast(people))  # a table of fixed size
    unsure = F.when((F.col("l_partkey") + F.col("r_regionkey")) % 3 != 0, F.col("passes"))
    rows = _verdicts(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey").crossJoin(F.broadcast(people)).withColumn("passes", unsure)
    rows = rows.withColumn("pass_confidence", scoring.pass_confidence(F.col("passes"), F.col("confidence")))
    return scoring.evaluated(pairs, rows, ("r_regionkey", "o_orderkey"), digits=6).select("r_regionkey", "o_orderkey", "status", "score", "n_criteria", "n_unknown")


def _eligibility(p: DataFrame) -> Column:
    """A text with headers, bullets and blank lines, of a part's fields; some parts lack one of the sections."""
    inclusion = F.concat(F.lit("About this\nInclusion  Criteria:\n\n* "), "p_name", F.lit("  and   more\n • "), "p_type", F.lit("\n"))
    exclusion = F.concat(F.lit("EXCLUSION criteria\n* "), "p_brand", F.lit("\n* size "), F.col("p_size").cast("string"))
    return F.when(p["p_partkey"] % 4 == 0, exclusion).when(p["p_partkey"] % 4 == 1, inclusion).when(p["p_partkey"] % 4 == 2, F.concat("p_name", F.lit("\n \n"), "p_type")).otherwise(F.concat(inclusion, exclusion))


@query("""WITH k AS (SELECT p_partkey, p_partkey%4 AS m, trim(regexp_replace(p_name,'\\s+',' ','g')) AS name, trim(regexp_replace(p_type,'\\s+',' ','g')) AS type, p_brand, p_size FROM part)
SELECT p_partkey, 'inclusion' AS kind, 0 AS idx, CASE WHEN m=2 THEN name ELSE name || ' and more' END AS text FROM k WHERE m<>0 UNION ALL SELECT p_partkey, 'inclusion', 1, type FROM k WHERE m<>0
UNION ALL SELECT p_partkey, 'exclusion', 0, p_brand FROM k WHERE m IN (0,3) UNION ALL SELECT p_partkey, 'exclusion', 1, 'size ' || p_size FROM k WHERE m IN (0,3)""")
def criteria_of_texts(spark, sf_dir):
    """Eligibility texts cut into sections and bullets, each numbered in its kind."""
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", F.explode(tx.criteria(_eligibility(p))).alias("c")).select("p_partkey", "c.kind", "c.idx", "c.text")


@query("""SELECT event_id, CASE user_id%6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 3 THEN FALSE END AS eligible, CASE WHEN user_id%6 IN (4,5) THEN 0.0::DOUBLE ELSE round(k/100.0,6)::DOUBLE END AS confidence,
CASE WHEN user_id%6 IN (4,5) THEN '' ELSE event_type END AS reasoning, user_id%6 IN (1,2,3) AS repaired, user_id%6 IN (4,5) AS failed FROM (SELECT event_id, user_id, event_type, event_id%98+2 AS k FROM events)""")
def judgments_of_texts(spark, sf_dir):
    """Model texts of six kinds: as asked, fenced, in prose with a word for null, aliased and broken, no object, no verdict."""
    e = _t(spark, sf_dir, "events").withColumn("k", (F.col("event_id") % 98 + 2).cast("string"))
    kinds = (
        ('{"eligible": true, "confidence": ', ', "reasoning": "', '"}'), ('Well:\n```json\n{"eligible": "no", "confidence": "', '%", "reasoning": "', '"}\n```'), ('I think it is {"eligible": unknown, "confidence": ', ', "reasoning": "', '",} or so'),
        ('{"verdict": False, "confidence": ', ', "rationale": "', '"}'), ("none ", " of ", " here"), ('{"eligible": "maybe", "confidence": ', ', "reasoning": "', '"}'),
    )
    raw = F.lit("")
    for n, (a, b, c) in enumerate(kinds):
        raw = F.when(F.col("user_id") % 6 == n, F.concat(F.lit(a), "k", F.lit(b), "event_type", F.lit(c))).otherwise(raw)
    j = judgment.answers(e.select("event_id", raw.alias("raw")), "raw", "j")
    return j.select("event_id", "j.eligible", F.round("j.confidence", 6).alias("confidence"), "j.reasoning", "j.repaired", F.col("j.parse_error").isNotNull().alias("failed"))


@query(f"""WITH {V} SELECT l_orderkey, l_partkey, '| ' || substr(kind,1,3) || ' | ' || l_partkey || ' | a\\|' || l_extendedprice::DECIMAL(18,2) || ' | ' || CASE WHEN eligible THEN 'met' WHEN NOT eligible THEN 'not met' ELSE 'unknown' END || ' | ' || printf('%.2f',confidence) || ' | ' ||
CASE WHEN passes THEN '✓' WHEN NOT passes THEN '✗' ELSE '?' END || ' | ' || route || ' | none |' AS line FROM v""")
def evidence_lines(spark, sf_dir):
    """The report's line for every criterion."""
    c = F.col
    text = F.concat(F.lit("a|"), c("l_extendedprice").cast("decimal(18,2)").cast("string"))
    return _verdicts(spark, sf_dir).select("l_orderkey", "l_partkey", report.verdict_line(c("kind"), c("l_partkey"), text, c("eligible"), c("confidence"), c("passes"), c("route"), F.lit("none")).alias("line"))


@query("""SELECT c_custkey, 'PATIENT PROFILE (as of 2026-09-30)' || chr(10) || 'Diagnosis: ' || c_name || ', stage ' || c_nationkey || CASE WHEN c_custkey%3=0 THEN ' (histology: ' || c_mktsegment || ')' ELSE '' END || chr(10) ||
'Age ' || c_nationkey || ', ' || lower(c_mktsegment) || '. ECOG 1. Smoking: ' || CASE WHEN c_custkey%2=0 THEN 'former' ELSE 'not recorded' END || '. Brain metastases: ' || CASE c_custkey%3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'not recorded' END || '. Prior malignancy: not recorded.' || chr(10) ||
'Mutations: ' || CASE WHEN c_custkey%2=0 THEN 'none reported' ELSE 'G' || c_nationkey || ' p.A1B (hotspot); H p.C2D' END || chr(10) || 'TMB ' || (c_custkey%50) || CASE WHEN c_custkey%2=0 THEN '.5' ELSE '' END || ' mut/Mb; PD-L1 TPS not recorded; MSI: MSS' || chr(10) || 'Treatment history (complete):' || chr(10) ||
CASE WHEN c_custkey%4=0 THEN '  none (treatment-naive)' ELSE '  Line 1: ' || c_name || ', 2025 to 2026, best response PD' || chr(10) || '  Line 2: x, 2026 to ongoing' END || chr(10) || 'Next line of therapy: ' || CASE WHEN c_custkey%4=0 THEN '1' ELSE '3' END AS profile FROM customer""")
def profile_texts(spark, sf_dir):
    """The profile of each customer as the text that judges read."""
    from datetime import date

    c = _t(spark, sf_dir, "customer")
    key, text, null = F.col("c_custkey"), lambda x: F.lit(x).cast("string"), F.lit(None).cast("string")
    mutation = lambda gene, change, hot: F.struct(gene.alias("gene"), F.lit(change).alias("protein_change"), F.lit(hot).alias("is_hotspot"))
    event = lambda line, drug, start, end, best: F.struct(F.lit(line).alias("line"), drug.alias("drug"), F.lit(start).alias("start_date"), end.alias("end_date"), best.alias("best_response"), null.alias("discontinuation_reason"))
    history = F.array(event(2, text("x"), "2026", null, null), event(1, F.col("c_name"), "2025", text("2026"), text("PD")))
    mutations = F.array(mutation(F.concat(F.lit("G"), F.col("c_nationkey").cast("string")), "p.A1B", True), mutation(text("H"), "p.C2D", False))
    p = c.select(
        "c_custkey", F.col("c_name").alias("diagnosis"), F.col("c_nationkey").cast("string").alias("stage"), F.when(key % 3 == 0, F.col("c_mktsegment")).alias("histology"), F.col("c_nationkey").alias("age_years"), F.col("c_mktsegment").alias("sex"), F.lit(1).alias("ecog"),
        F.when(key % 2 == 0, "former").alias("smoking_status"), F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("brain_metastases"), null.alias("prior_malignancy"), F.when(key % 2 == 1, mutations).otherwise(F.slice(mutations, 1, 0)).alias("mutations"),
        (key % 50 + F.when(key % 2 == 0, 0.5).otherwise(0.0)).alias("tmb"), F.lit(None).cast("double").alias("pd_l1_tps"), text("MSS").alias("msi_status"), F.when(key % 4 != 0, history).otherwise(F.slice(history, 1, 0)).alias("treatment_history"),
    )
    return p.select("c_custkey", patient.summary(date(2026, 9, 30)).alias("profile"))


@query("""SELECT o_orderkey, sum(CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END)::INT AS n_inclusion, sum(CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END)::INT AS n_exclusion, coalesce(array_to_string(list_sort(list_distinct(list(l_returnflag))),','),'') AS genes,
coalesce(bool_or(l_returnflag='R'),FALSE) AS any_biomarker FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1""")
def breakdown_of_trials(spark, sf_dir):
    """Criteria of each kind and distinct genes of a trial; a criterion has a biomarker where its features name one."""
    empty = F.array().cast("array<string>")
    features = F.struct(F.array("l_returnflag").alias("biomarkers"), empty.alias("mutations"))
    flagged = F.struct(F.when(F.col("l_returnflag") == "R", F.array("l_returnflag")).otherwise(empty).alias("biomarkers"), F.lit(None).cast("array<string>").alias("mutations"))
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("nct_id"), F.struct(F.when(F.col("l_linestatus") == "O", "inclusion").otherwise("exclusion").alias("kind"), features.alias("features")).alias("c"), scoring.is_biomarker(flagged).alias("b"))
    trials = li.groupBy("nct_id").agg(F.collect_list("c").alias("criteria"), F.max("b").alias("any_biomarker"))
    return ingest.breakdown(trials).join(trials.select("nct_id", "any_biomarker"), "nct_id").select(F.col("nct_id").alias("o_orderkey"), "n_inclusion", "n_exclusion", F.array_join("genes", ",").alias("genes"), "any_biomarker")


@query("SELECT event_type, count(*) AS n, round(avg(value),6) AS mean, round(median(value),6) AS median, round(quantile_cont(value,0.95),6) AS p95, max(value) AS max FROM events GROUP BY 1")
def latency_stats(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.max("value").alias("max"))


@query("SELECT event_id, 'local' AS backend, value FROM events WHERE event_type='click' AND user_id%7<>0")
def log_filter(spark, sf_dir):
    """Calls of the local judge without an error; an empty text is none."""
    error = F.when(F.col("user_id") % 7 == 0, "failed").when(F.col("user_id") % 2 == 0, "")
    log = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "local").otherwise("api").alias("backend"), "value", error.alias("error"))
    return readers.successful_local_calls(log).drop("error")


@dataclass(frozen=True)
class _Failing(judging.RulesJudge):
    """Rules that have no answer where a text has the word ``without``."""

    without: str = ""

    def complete(self, profile, criterion):
        if self.without in criterion.split():
            raise judging.JudgeError("no answer")
        return super().complete(profile, criterion)


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN TRUE WHEN 'error' THEN FALSE END AS eligible, CASE WHEN event_type IN ('click','error') THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
CASE WHEN event_id%7=3 THEN 2 ELSE 1 END AS n_calls, CASE WHEN event_id%7=3 THEN 1 ELSE 0 END AS n_failed FROM events""")
def failed_calls(spark, sf_dir):
    """A judge fails on each seventh event; a second run asks it for these alone."""
    calls = _t(spark, sf_dir, "events").select("event_id", F.lit("p").alias("profile"), F.concat_ws(" ", "event_type", (F.col("event_id") % 7).cast("string")).alias("text"))
    rules, path = ((("click",), True, 0.8), (("error",), False, 0.8)), f"{readers.shared_root(spark)}/answers-{uuid.uuid4().hex}"
    for judge in (_Failing(rules, without="3"), judging.RulesJudge(rules)):
        every = answers.asked(calls, judge, path, "local", ["event_id"], give_up=2**31)
    ok = F.col("answer.error").isNull()
    return every.groupBy("event_id").agg(F.bool_and(F.when(ok, F.col("answer.eligible"))).alias("eligible"), F.max(F.when(ok, F.col("answer.confidence"))).alias("confidence"), F.count("*").alias("n_calls"), F.count_if(~ok).alias("n_failed"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))),'; ') AS priorities, count(DISTINCT o_orderstatus) AS n_status FROM orders GROUP BY 1")
def distinct_sorted(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("priorities"), F.count_distinct("o_orderstatus").alias("n_status"))


@query("""WITH h AS (SELECT sha256(doc_id || chr(31) || text || chr(30)) AS h FROM documents), p AS (SELECT sum(('0x' || substr(h,1,15))::BIGINT::HUGEINT) AS a, sum(('0x' || substr(h,16,15))::BIGINT::HUGEINT) AS b, count(*) AS n FROM h)
SELECT substr(sha256('model|' || a || '|' || b || '|' || n),1,16) AS fingerprint FROM p""")
def fingerprint(spark, sf_dir):
    """The fingerprint of the whole corpus, whatever its order."""
    return retrieval.large_fingerprint("model", _t(spark, sf_dir, "documents"), "doc_id", "text")


@query(rf"""WITH {E} SELECT o_orderkey, '| ' || rank || ' | ' || o_orderkey || ' | ' || status || ' | ' || printf('%.6f',score) || ' | ' || printf('%.4f',retrieval_score) || ' | ' || n_pass || '/' || n_fail || '/' || n_unknown || ' | t\|' || o_custkey || ' |' AS line
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {PLACE}, score DESC, retrieval_score DESC, o_orderkey) AS rank FROM e)""")
def report_rows(spark, sf_dir):
    c = F.col
    t = report.ranked(_evaluated(spark, sf_dir), "o_orderkey", "o_custkey")
    return t.select("o_orderkey", report.table_line(c("rank"), c("o_orderkey"), c("status"), c("score"), c("retrieval_score"), (c("n_pass"), c("n_fail"), c("n_unknown")), F.concat(F.lit("t|"), c("o_custkey").cast("string")), digits=6).alias("line"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_group(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("r", F.row_number().over(w)).filter("r <= 3").drop("r")


@query("SELECT l_orderkey, l_partkey, round(l_extendedprice/7,3) AS r3, least(greatest(l_discount*20,0.2),0.8) AS clamped FROM lineitem")
def round_clamp(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") / 7, 3).alias("r3"), F.least(F.greatest(F.col("l_discount") * 20, F.lit(0.2)), F.lit(0.8)).alias("clamped"))
