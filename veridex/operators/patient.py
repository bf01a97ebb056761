"""Functions of a profile row: membership, last response, next line, query, summary and messages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridex.functions.text import shown, shown_number, stripped

#: The lines of a profile's text, and what is said where nothing is known.
TITLE = "PATIENT PROFILE (as of %s)"
DIAGNOSIS, STAGE, HISTOLOGY = "Diagnosis: ", ", stage ", (" (histology: ", ")")
AGE, ECOG, SMOKING, BRAIN, MALIGNANCY, END = "Age ", ". ECOG ", ". Smoking: ", ". Brain metastases: ", ". Prior malignancy: ", "."
MUTATIONS, HOTSPOT, NO_MUTATIONS = "Mutations: ", " (hotspot)", "none reported"
TMB, PER_MB, PD_L1, MSI = "TMB ", " mut/Mb", "; PD-L1 TPS ", "; MSI: "
HISTORY, NO_HISTORY = "Treatment history (complete):", "  none (treatment-naive)"
LINE, TO, ONGOING, RESPONSE, STOPPED = "  Line ", " to ", "ongoing", ", best response ", ", stopped for "
NEXT = "Next line of therapy: "
UNKNOWN = "not recorded"


def has_mutation(mutations: Column, gene: str, change: str | None = None) -> Column:
    """By gene in any case and, if given, by protein change without its ``p.`` prefixes."""
    bare = lambda c: F.replace(F.upper(c), F.lit("P."), F.lit(""))
    return F.exists(mutations, lambda m: (F.upper(m["gene"]) == gene.upper()) & (F.lit(True) if change is None else bare(m["protein_change"]) == bare(F.lit(change))))


def prior_response_to(history: Column, word: str) -> Column:
    """Best response to the last treatment in the list whose drug has the word."""
    return F.try_element_at(F.filter(history, lambda t: F.contains(F.lower(t["drug"]), F.lit(word.lower()))), F.lit(-1))["best_response"]


def prior_drugs(history: Column) -> Column:
    return history["drug"]


def current_line(history: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(history, lambda t: t["line"])), F.lit(0)) + 1


def query(p: str = "") -> Column:
    """What a profile is searched by; hotspots count twice, drugs are left out."""
    c = lambda n: F.col(p + n)
    dx, change = F.lower(c("diagnosis")), lambda m: F.regexp_replace(m["protein_change"], r"^p\.", "")
    none = F.array().cast("array<string>")
    histology = F.coalesce(c("histology"), F.lit(""))
    terms = F.concat(
        F.array(c("diagnosis"), F.concat(F.lit("stage "), c("stage"))),
        F.when((histology != "") & ~F.contains(dx, F.lower(histology)), F.array(histology)).otherwise(none),
        F.when(F.contains(dx, F.lit("lung")) & F.contains(dx, F.lit("adenocarcinoma")), F.array(F.lit("non-small cell lung cancer NSCLC"))).otherwise(none),
        F.flatten(F.transform(F.coalesce(c("mutations"), F.array()), lambda m: F.when(m["is_hotspot"], F.array(F.concat_ws(" ", m["gene"], change(m)), F.concat_ws(" ", m["gene"], change(m), F.lit("mutation")))).otherwise(F.array(m["gene"])))),
        F.when(F.coalesce(F.size(c("treatment_history")), F.lit(0)) > 0, F.array(F.lit("previously treated advanced metastatic"))).otherwise(none),
    )
    return F.array_join(terms, " ")


def summary(as_of: date) -> Column:
    """The profile as text; what is not known is said outright."""
    c, said = F.col, F.lit
    given = lambda x: F.coalesce(x, said("")) != ""
    text = lambda n: c(n).cast("string")
    part = lambda before, x: F.when(given(x), F.concat(said(before), x)).otherwise("")
    mutations = F.array_join(F.transform("mutations", lambda m: F.concat(m["gene"], said(" "), m["protein_change"], F.when(m["is_hotspot"], HOTSPOT).otherwise(""))), "; ")
    history = F.array_sort(F.transform("treatment_history", lambda t, i: F.struct(t["line"].alias("line"), i.alias("i"), t.alias("t"))))
    span = lambda t: F.concat(t["start_date"], said(TO), F.coalesce(F.nullif(t["end_date"], said("")), said(ONGOING)))
    line = lambda t: F.concat(said(LINE), t["line"].cast("string"), said(": "), t["drug"], said(", "), span(t), part(RESPONSE, t["best_response"]), part(STOPPED, t["discontinuation_reason"]))
    brain = F.when(c("brain_metastases"), "yes").when(~c("brain_metastases"), "no").otherwise(UNKNOWN)
    return F.concat_ws(
        "\n", said(TITLE % as_of.isoformat()),
        F.concat(said(DIAGNOSIS), c("diagnosis"), said(STAGE), c("stage"), F.when(given(c("histology")), F.concat(said(HISTOLOGY[0]), c("histology"), said(HISTOLOGY[1]))).otherwise("")),
        F.concat(said(AGE), text("age_years"), said(", "), F.lower("sex"), said(ECOG), text("ecog"), said(SMOKING), shown(c("smoking_status"), missing=UNKNOWN), said(BRAIN), brain, said(MALIGNANCY), shown(c("prior_malignancy"), missing=UNKNOWN), said(END)),
        F.concat(said(MUTATIONS), F.coalesce(F.nullif(mutations, said("")), said(NO_MUTATIONS))),
        F.concat(said(TMB), shown_number(c("tmb"), PER_MB, UNKNOWN), said(PD_L1), shown_number(c("pd_l1_tps"), "%", UNKNOWN), said(MSI), shown(c("msi_status"), missing=UNKNOWN)),
        said(HISTORY), F.when(F.coalesce(F.size("treatment_history"), said(0)) == 0, NO_HISTORY).otherwise(F.array_join(F.transform(history, lambda h: line(h["t"])), "\n")),
        F.concat(said(NEXT), current_line(c("treatment_history")).cast("string")),
    )


def user_turn(profile: Column, criterion: Column) -> Column:
    return F.concat(profile, F.lit("\n\nCRITERION\n"), stripped(criterion))


def messages(profile: Column, criterion: Column, example: tuple[str, str, str]) -> Column:
    """A worked example, then the question: array of ``role, content``."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("user", user_turn(F.lit(example[0]), F.lit(example[1]))), turn("assistant", F.lit(example[2])), turn("user", user_turn(profile, criterion)))


def prompt_version(*texts: str) -> Column:
    return F.substring(F.sha2(F.lit("\x1f".join(texts)), 256), 1, 12)
