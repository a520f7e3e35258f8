"""Queries and DuckDB oracles of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_token_alignment
from .decontam import op5_decontamination
from .langid import op10_language_id
from .linededup import OP3_SQL, op3_line_dedup
from .lpf import OP4_SQL, op4_suffix_dedup
from .mixing import OP6_SQL, op6_mixing
from .quality import op1_quality
from .simhash import op8_simhash
from .substring import OP9_SQL, op9_substring_dedup
from .tokens import op2_token_counts
from .topk import OP7_SQL, op7_exact_topk
from .toxicity import op13_toxicity
from .wavelet import OP11_SQL, op11_ranked_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_token_counts": op2_token_counts,
        "op3_line_dedup": op3_line_dedup,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_decontamination": op5_decontamination,
        "op6_mixing": op6_mixing,
        "op7_exact_topk": op7_exact_topk,
        "op8_simhash": op8_simhash,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_language_id": op10_language_id,
        "op11_ranked_search": op11_ranked_search,
        "op12_token_alignment": op12_token_alignment,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op6_mixing": OP6_SQL, "op7_exact_topk": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op11_ranked_search": OP11_SQL}
