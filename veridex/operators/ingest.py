"""Raw studies to parsed trials and criteria rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions.text import criteria, document


def countries(locations: Column) -> Column:
    names = F.transform(F.coalesce(locations, F.array()), lambda x: x["country"])
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: F.coalesce(x, F.lit("")) != "")))


def parsed_trials(studies: DataFrame) -> DataFrame:
    """One narrow stage: flatten, split the eligibility text, extract features. Missing modules give nulls and empty
    arrays."""
    of = lambda path: F.col(f"protocolSection.{path}")
    strings = F.array().cast("array<string>")
    arms = F.coalesce(of("armsInterventionsModule.interventions"), F.array().cast("array<struct<type:string,name:string>>"))
    found = studies.select(
        of("identificationModule.nctId").alias("nct_id"), of("identificationModule.briefTitle").alias("title"), of("identificationModule.officialTitle").alias("official_title"),
        of("statusModule.overallStatus").alias("status"), F.coalesce(of("designModule.phases"), strings).alias("phase"), of("designModule.studyType").alias("study_type"),
        F.coalesce(of("conditionsModule.conditions"), strings).alias("conditions"), F.transform(arms, lambda x: F.struct(x["type"].alias("type"), x["name"].alias("name"))).alias("interventions"),
        of("eligibilityModule.minimumAge").alias("min_age"), of("eligibilityModule.maximumAge").alias("max_age"), of("eligibilityModule.sex").alias("sex"), of("eligibilityModule.healthyVolunteers").alias("healthy_volunteers"),
        countries(of("contactsLocationsModule.locations")).alias("countries"), criteria(of("eligibilityModule.eligibilityCriteria")).alias("criteria"),
    )
    return found.withColumn("n_criteria", F.size("criteria"))


def criteria_rows(trials: DataFrame) -> DataFrame:
    return trials.select("nct_id", F.posexplode("criteria").alias("pos", "c")).select("nct_id", "pos", "c.*")


def trial_documents(trials: DataFrame) -> DataFrame:
    return trials.select("nct_id", document(F.col("title"), F.col("official_title"), F.col("conditions"), F.transform("interventions", lambda i: i["name"])).alias("text"))


def breakdown(trials: DataFrame) -> DataFrame:
    """Criteria of each kind and distinct genes by trial; a narrow stage."""
    of = lambda kind: F.size(F.filter("criteria", lambda c: c["kind"] == kind))
    genes = F.flatten(F.transform("criteria", lambda c: F.coalesce(c["features"]["biomarkers"], F.array().cast("array<string>"))))
    return trials.select("nct_id", of("inclusion").alias("n_inclusion"), of("exclusion").alias("n_exclusion"), F.array_sort(F.array_distinct(genes)).alias("genes"))


def totals(trials: DataFrame) -> DataFrame:
    return trials.agg(F.count("*").alias("n_trials"), F.coalesce(F.sum("n_criteria"), F.lit(0)).alias("n_criteria"))
