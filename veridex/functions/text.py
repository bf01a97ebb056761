"""Text functions: cleaning, tokens, documents, criteria sections and features, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without weight in retrieval.
STOPWORDS = ("a", "an", "and", "as", "at", "by", "for", "in", "of", "on", "or", "the", "to", "with", "without", "vs", "versus", "study", "trial", "phase", "patients", "participants", "subjects")
#: Gene and marker names.
BIOMARKERS = r"KRAS|EGFR|BRAF|ALK|ROS1|MET|RET|HER2|ERBB2|PIK3CA|STK11|KEAP1|NTRK\d|TP53|NRAS|BRCA1|BRCA2|PD-L1|PDL1|TMB|MSI"
#: Variants such as G12C, and alterations by name.
MUTATIONS = r"[A-Z]\d{1,4}[A-Z*]|exon\s*\d+\s*(?:deletion|insertion|skipping)|amplification|fusion|rearrangement"
#: Performance status, least age, earlier therapy and brain metastases in running text.
ECOG = r"(?diU)ECOG.{0,40}?(?:performance status\s*)?(?:of\s*)?(?:<=|≤|less than or equal to|of at most)?\s*(\d)(?:\s*(?:to|-|or)\s*(\d))?"
AGE = r"(?diU)(?:age|aged)\s*(?:>=|≥|at least|of)\s*(\d+)\s*years?"
PRIOR_THERAPY = r"(?diU)\b(prior|previous|previously)\b.{0,50}?\b(treatment|therapy|line|systemic|chemotherapy|TKI|immunotherapy|inhibitor)\b"
BRAIN = r"(?diU)\bbrain\s+metasta[sc]e[sd]?\b|CNS metasta"


def stripped(text: Column) -> Column:
    """Without white space at either end; any Unicode white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, in order, without stop words and single characters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def document(title: Column, official: Column, conditions: Column, interventions: Column) -> Column:
    """What a trial is indexed by: titles, conditions and intervention names, the empty ones left out."""
    parts = F.concat(F.array(title, official), F.coalesce(conditions, F.array().cast("array<string>")), F.coalesce(interventions, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), " . ")


def markdown_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def shown(value: Column, suffix: str = "", missing: str = "not recorded") -> Column:
    """A value for reading; null is said outright."""
    return F.coalesce(F.concat(value.cast("string"), F.lit(suffix)), F.lit(missing))


def shown_number(value: Column, suffix: str = "", missing: str = "not recorded") -> Column:
    """A number in six significant digits without trailing zeros."""
    digits = F.regexp_replace(F.format_string("%.6g", value), r"(\.\d*?)0+(e|$)", "$1$2")
    return F.when(value.isNull(), missing).otherwise(F.concat(F.regexp_replace(digits, r"\.(e|$)", "$1"), F.lit(suffix)))


def _distinct_upper(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(?diU)\b({pattern})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def features(text: Column) -> Column:
    """Struct of what a criterion's text says; a field is null where it says nothing. Arrays are sorted."""
    none = F.lit(None)

    def some(array: Column) -> Column:
        return F.when(F.size(array) > 0, array)

    low = _first(text, ECOG, 1).try_cast("int")
    high = _first(text, ECOG, 2).try_cast("int")
    most = F.greatest(low, F.coalesce(high, low))
    return F.struct(
        some(_distinct_upper(text, BIOMARKERS)).alias("biomarkers"),
        some(_distinct_upper(text, MUTATIONS)).alias("mutations"),
        most.alias("ecog_max"),
        _first(text, AGE, 1).try_cast("int").alias("min_age_years"),
        F.when(text.rlike(PRIOR_THERAPY), True).otherwise(none.cast("boolean")).alias("prior_therapy_relevant"),
        F.when(text.rlike(BRAIN), True).otherwise(none.cast("boolean")).alias("mentions_brain_mets"),
    )


def bullets(block: Column) -> Column:
    """Items of a section: split at bullets, or where there is one at most, the block split at blank lines."""
    cleaned = lambda parts: F.filter(F.transform(parts, collapsed), lambda p: p != "")
    by_bullet = cleaned(F.split(block, r"(?U)(?:^|\n)\s*\*\s*", -1))
    return F.when(F.size(by_bullet) > 1, by_bullet).otherwise(cleaned(F.split(block, r"(?U)\n\s*\n", -1)))


def sections(text: Column) -> tuple[Column, Column]:
    """Inclusion and exclusion part of an eligibility text; without headers all of it is inclusion."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("•"), F.lit("*"))

    def header(word: str) -> tuple[Column, Column]:
        pattern = rf"(?iU){word}\s+criteria\s*:?"
        start = F.regexp_instr(text, F.lit(pattern))
        return start, start + F.length(F.regexp_extract(text, pattern, 0))

    (inc, inc_end), (exc, exc_end) = header("inclusion"), header("exclusion")
    rest = lambda at: F.substring(text, at, F.length(text))
    inclusion = F.when((inc > 0) & (exc > 0), F.substring(text, inc_end, F.greatest(exc - inc_end, F.lit(0)))).when(inc > 0, rest(inc_end)).when(exc > 0, "").otherwise(text)
    return inclusion, F.when(exc > 0, rest(exc_end)).otherwise("")


def criteria(text: Column) -> Column:
    """Ordered array of ``kind, idx, text, features``: inclusion first, numbered from 0 in each kind."""
    def of(kind: str, block: Column) -> Column:
        return F.transform(bullets(block), lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("idx"), t.alias("text"), features(t).alias("features")))

    inclusion, exclusion = sections(text)
    return F.concat(of("inclusion", inclusion), of("exclusion", exclusion))
