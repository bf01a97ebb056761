"""The training-data queries and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veridex.llm import oracle_sql
from veridex.llm._common import table
from veridex.llm.decontamination import op9_decontamination
from veridex.llm.grammar_shards import op8_grammar_shards
from veridex.llm.html_extraction import op10_html_extraction
from veridex.llm.near_duplicates import op6_near_duplicates
from veridex.llm.packing import op3_packing
from veridex.llm.periodic_runs import op12_periodic_runs
from veridex.llm.personal_data import op1_personal_data, personal_data
from veridex.llm.prefix_bpe import op11_prefix_bpe
from veridex.llm.repetition_quality import op4_repetition_quality
from veridex.llm.sentence_spans import op5_sentence_spans
from veridex.llm.token_counts import op2_token_counts
from veridex.llm.url_rules import op7_url_rules


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of ``op1_personal_data``: its base counts."""
    return personal_data(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_repetition_quality": op4_repetition_quality,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_url_rules": op7_url_rules,
    "op8_grammar_shards": op8_grammar_shards,
    "op9_decontamination": op9_decontamination,
    "op10_html_extraction": op10_html_extraction,
    "op11_prefix_bpe": op11_prefix_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "personal_data_base": personal_data_base,
}

#: Tokens, trees, samples, cuts, refinements and spans of sentences are beyond SQL: tests hold these against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_repetition_quality": oracle_sql.quality(),
    "op7_url_rules": oracle_sql.url_rules(),
    "op9_decontamination": oracle_sql.decontamination(),
    "personal_data_base": oracle_sql.personal_data_base(),
}
