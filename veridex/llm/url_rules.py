"""URL verdicts by listed rules and, where none fits, by association rules mined from labelled URLs.

A URL becomes a set of tokens: the labels of its host, its path segments and the names of its query fields, each with
where it stood; numbers are one token. FP-growth mines token combinations of labelled URLs together with the label;
rules that predict a bad label with enough confidence, support and lift over the share of bad labels are kept, but for
those that a kept, shorter rule implies. An inverted index, a table, gives the rules by their rarest token; a rule fires
where all its tokens are found. All of it is DataFrame functions and Spark's own FP-growth, and nothing bounds the number
or the length of rules.

A null URL, or one without ``://``, has an empty host and path and no tokens; it is allowed unless a rule fits. Labels
with a null id or a null label aren't used; where an id has several, one bad label counts. Without labels, or without
a rule that is confident enough, everything that no listed rule blocks is allowed. Rows with equal or null ids are
judged one by one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm._common import _quoted, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host with path prefix, verdict.
LISTED = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits the host, or a domain above it, and the path's beginning."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, what in sorted(rules, key=lambda r: len(r[0])):
        domain, _, rest = name.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; empty where it has no host."""
    host, path = host_of(url), path_of(url)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))

    def named(kind: str, parts: Column) -> Column:
        used = F.filter(parts, lambda x: x != "")
        return F.transform(used, lambda x: F.concat(F.lit(kind), F.when(x.rlike(r"^[0-9]+(\.[a-z]+)?$"), "#").otherwise(x)))

    fields = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(named("h:", F.split(host, r"\.")), named("p:", F.split(F.translate(path, UPPER, LOWER), "/")), named("q:", fields))))


def mined_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_lift: float = 1.5, min_rows: int = 10, most_rows: int = 200_000) -> DataFrame | None:
    """``rule, tokens, rare``: token sets that predict a bad label, from ``url, bad``; None where too few rows are labelled.
    ``rare`` is the token of the set that fewest labelled rows have.

    ``min_support`` is the share, ``min_rows`` the number of labelled rows that have the set and a bad label. The model is
    fitted on at most ``most_rows`` labelled rows, those with the smallest hash of their URL.

    Only what can be part of a rule that no other implies is mined: tokens of enough bad rows, without those that are rules
    alone, and one of those that the very same rows have (it stands for the others, so that copies of a URL of many tokens
    aren't all their subsets). FP-growth counts sets in bad rows, the index in all.
    """
    rows = labelled.select(F.coalesce(F.col("url"), F.lit("")).alias("url"), "bad").withColumn("h", F.xxhash64("url")).orderBy("h", "url", "bad").limit(most_rows)
    rows = written(rows.groupBy(F.array_sort(tokens_of(F.col("url"))).alias("tokens"), "bad").agg(F.count("*").alias("n")).withColumn("row", F.xxhash64("tokens", "bad")), "url-tokens")
    n, n_bad = (x or 0 for x in rows.agg(F.sum("n"), F.sum(F.when(F.col("bad"), F.col("n")))).first())
    need = ceil(max(min_support * n, min_rows) - 1e-9)
    if need > n:
        return None
    least = max(min_confidence, min_lift * n_bad / n)
    good = F.col("n_bad") >= least * F.col("n")
    bad_n = F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("n_bad")
    each = rows.select("row", "bad", "n", F.explode("tokens").alias("token"))
    tokens = written(each.groupBy("token").agg(F.sum("n").alias("n"), bad_n, F.count("*").alias("rows"), F.bit_xor("row").alias("same")).filter(F.col("n_bad") >= need), "url-token-counts")
    some = tokens.filter(~good).groupBy("n", "n_bad", "rows", "same").agg(F.min("token").alias("token"))
    baskets = each.filter("bad").join(some.select("token"), "token").groupBy("row", "n").agg(F.collect_list("token").alias("items"))
    baskets = written(baskets.filter(F.size("items") > 1).select(F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"), "items"), "url-baskets")
    alone = tokens.filter(good).select(F.array("token").alias("tokens"), F.col("token").alias("rare"))
    if (size := baskets.count()) < need:
        found = alone
    else:
        sets = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / size).fit(baskets).freqItemsets.filter(F.size("items") > 1).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n_bad"))
        rarest = sets.select("tokens", "n_bad", F.explode("tokens").alias("token")).join(some.select("token", "n"), "token").groupBy("tokens", "n_bad").agg(F.min(F.struct("n", "token"))["token"].alias("rare"))
        counted = _having(rows.select("n", F.col("tokens").alias("own")), rarest).groupBy("tokens", "rare", "n_bad").agg(F.sum("n").alias("n"))
        found = alone.unionByName(counted.filter(good).select("tokens", "rare"))
    return _not_implied(written(found.select(F.xxhash64("tokens").alias("rule"), "tokens", "rare"), "url-rules"))


def _having(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (``own`` tokens) with each of ``sets`` whose tokens they have all, by the index of the sets' rarest tokens."""
    words = rows.withColumn("token", F.explode("own"))
    return words.join(sets.withColumn("token", F.col("rare")), "token").filter(F.size(F.array_except("tokens", "own")) == 0)


def _not_implied(rules: DataFrame) -> DataFrame:
    """The rules without those that have all tokens of another: what fires the other says all."""
    longer = rules.select(F.col("rule").alias("longer"), F.col("tokens").alias("own"))
    implied = _having(longer, rules).filter(F.size("tokens") < F.size("own"))
    return rules.join(implied.select(F.col("longer").alias("rule")).distinct(), "rule", "left_anti")


def firing(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``url`` of those (``url``) for which all tokens of any rule are found, by the index of rarest tokens."""
    return _having(urls.select("url").distinct().select("url", tokens_of(F.col("url")).alias("own")), rules).select("url").distinct()


def url_verdicts(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = LISTED, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id", label_col: str = "toxic", **mining) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page. ``mining``: parameters of ``mined_rules``."""
    urls = pages.select(_quoted(id_col).cast("long").alias("page_id"), _quoted(url_col).alias("url"))
    known = labels.select(_quoted(label_id_col).cast("long").alias("page_id"), _quoted(label_col).cast("int").alias("label")).dropna().groupBy("page_id").agg(F.max(F.col("label") > 0).alias("bad"))
    mined = mined_rules(urls.join(known, "page_id").select("url", "bad"), **mining)
    if mined is None or mined.isEmpty():
        judged = urls.withColumn("bad", F.lit(False))
    else:
        judged = urls.join(firing(urls, mined).withColumn("bad", F.lit(True)), "url", "left")
    url = F.col("url")
    judged = judged.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "bad")
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
