"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veingraph.llm.decontam import decontam_sql, op3_positional_index
from veingraph.llm.licenses import op10_diagonal_voting
from veingraph.llm.lines import lines_sql, op9_log_templates
from veingraph.llm.mixing import mixing_sql, op2_poisson_mixing
from veingraph.llm.neardup import op4_dart_minhash
from veingraph.llm.quality import op6_decision_list
from veingraph.llm.substrings import op1_recompression, substrings_sql
from veingraph.llm.suffixes import op7_suffix_arrays
from veingraph.llm.tokens import op5_token_counts
from veingraph.llm.url_filter import op8_url_language_model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_recompression,
        op2_poisson_mixing,
        op3_positional_index,
        op4_dart_minhash,
        op5_token_counts,
        op6_decision_list,
        op7_suffix_arrays,
        op8_url_language_model,
        op9_log_templates,
        op10_diagonal_voting,
    )
}

SQL: dict[str, str] = {
    "op1_recompression": substrings_sql(),
    "op2_poisson_mixing": mixing_sql(),
    "op3_positional_index": decontam_sql(),
    "op9_log_templates": lines_sql(),
}
