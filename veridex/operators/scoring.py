"""From verdicts to statuses, scores, ranks and run summaries.

A verdict is true, false or null (unknown); null is never true and never false, and a plain aggregate that skips nulls
would be wrong for most rules here.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Band in which a verdict is asked again (both ends included), least confidence that decides (not
#: included), weights.
BAND, DECISIVE, BIOMARKER_WEIGHT, WEIGHT = (0.35, 0.75), 0.5, 2.0, 1.0
STATUSES = ("eligible", "unresolved", "ineligible")


def in_band(confidence: Column) -> Column:
    return confidence.between(*BAND)


def is_biomarker(features: Column) -> Column:
    """Whether a criterion's features name a gene or a variant."""
    return (F.coalesce(F.size(features["biomarkers"]), F.lit(0)) > 0) | (F.coalesce(F.size(features["mutations"]), F.lit(0)) > 0)


def weight(biomarker: Column) -> Column:
    return F.when(biomarker, BIOMARKER_WEIGHT).otherwise(WEIGHT)


def passes(kind: Column, eligible: Column) -> Column:
    """Inclusion criteria pass where true, all other kinds where false; unknown stays unknown."""
    return F.when(kind == "inclusion", eligible).otherwise(~eligible)


def pass_confidence(passed: Column, confidence: Column) -> Column:
    return F.when(passed.isNull(), 0.5).when(passed, confidence).otherwise(1.0 - confidence)


def route(confidence: Column, has_second: Column) -> Column:
    return F.when(~in_band(confidence), "local").when(has_second, "api").otherwise("api_unavailable")


def evaluated(trials: DataFrame, verdicts: DataFrame, key: str | Sequence[str], position: Sequence[str] = ("kind_order", "idx"), digits: int = 4, details: Sequence[str] = ()) -> DataFrame:
    """Status, score and counts of each trial from verdicts with ``passes, confidence, weight, pass_confidence, route``.

    ``key`` is one column or several, such as patient and trial; nulls in it equal each other.
    Trials without verdicts are unresolved with score 0 and a note. Sums are partial before the shuffle. With
    ``details`` (columns of ``verdicts``) also ``blocking``, the blockers in the order of ``position``.
    """
    confident = F.col("confidence") > DECISIVE
    blocks = ~F.col("passes") & confident
    blocking = [F.sort_array(F.collect_list(F.when(blocks, F.struct(*position, *details)))).alias("blocking")] if details else []
    keys = [key] if isinstance(key, str) else list(key)
    sums = verdicts.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(
        F.max(F.coalesce(blocks, F.lit(False))).alias("blocked"), F.min(F.coalesce(F.col("passes") & confident, F.lit(False))).alias("all_pass"),
        F.sum(F.col("weight") * F.col("pass_confidence")).alias("total"), F.sum("weight").alias("weights"),
        F.count_if("passes").alias("n_pass"), F.count_if(~F.col("passes")).alias("n_fail"), F.count_if(F.col("passes").isNull()).alias("n_unknown"),
        F.count("*").alias("n_criteria"), F.count_if(F.col("route") == "api").alias("n_routed_api"), F.count_if(F.col("route") == "api_unavailable").alias("n_api_unavailable"), *blocking,
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    counts = ("n_pass", "n_fail", "n_unknown", "n_criteria", "n_routed_api", "n_api_unavailable")
    on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return trials.join(sums, on, "left").select(
        *trials.columns,
        F.when(F.col("blocked"), "ineligible").when(F.col("all_pass"), "eligible").otherwise("unresolved").alias("status"),
        F.coalesce(F.round(F.col("total") / F.col("weights"), digits), F.lit(0.0)).alias("score"), *map(zero, counts),
        F.when(F.col("n_criteria").isNull(), "no criteria parsed").alias("note"), *(["blocking"] if details else []),
    )


def rank_order(status: Column, score: Column, retrieval: Column, *ties: Column) -> list[Column]:
    """Eligible, unresolved, ineligible, others; then score, retrieval score and input order."""
    place = F.coalesce(F.create_map(*(x for k, s in enumerate(STATUSES) for x in (F.lit(s), F.lit(k))))[status], F.lit(9))
    return [place.asc(), F.coalesce(score, F.lit(0.0)).desc(), F.coalesce(retrieval, F.lit(0.0)).desc(), *(t.asc() for t in ties)]


def run_summary(trials: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row of headline numbers. ``verdicts`` has structs ``local`` and ``api`` (null where not asked again)."""
    local, api = F.col("local"), F.col("api")
    n = F.nullif(F.count("*"), F.lit(0))
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long")
    of_verdicts = verdicts.agg(
        F.count("*").alias("n_criteria"), F.count_if(F.col("eligible").isNull()).alias("n_unknown_criteria"),
        F.round(F.avg(local["latency_s"]), 3).alias("mean_local_latency_s"),
        F.round(F.avg(local["latency_s"] + F.coalesce(api["latency_s"], F.lit(0.0))), 3).alias("mean_criterion_time_s"),
        F.round(F.count_if(F.col("route").isin("api", "api_unavailable")) / n, 4).alias("routing_band_rate"),
        F.count_if(F.col("route") == "api").alias("n_routed_api"), F.round(F.count_if(F.col("route") == "api") / n, 4).alias("api_routing_rate"),
        F.count_if(F.col("route") == "api_unavailable").alias("n_api_unavailable"),
        F.count_if(api.isNotNull() & ~api["eligible"].eqNullSafe(local["eligible"])).alias("n_api_flipped"),
        F.count_if(F.coalesce(local["parse_error"], api["parse_error"]).isNotNull()).alias("n_parse_errors"),
        *(total(side[f"{way}_tokens"]).alias(f"{way}_tokens_{name}") for way in ("input", "output") for side, name in ((local, "local"), (api, "api"))),
    )
    of_trials = trials.agg(F.count("*").alias("n_trials"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES))
    return of_trials.crossJoin(of_verdicts)  # one row each


def models(verdicts: DataFrame) -> DataFrame:
    """One row: the distinct models that judged, in order."""
    names = F.array_distinct(F.flatten(F.collect_set(F.filter(F.array("local.model", "api.model"), lambda m: m.isNotNull()))))
    return verdicts.agg(F.array_sort(names).alias("models"))
