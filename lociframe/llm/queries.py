"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP13_SQL, op13_collocations
from .decontaminate import op5_decontaminate
from .embedding_dedup import op6_embedding_dedup
from .language import op3_language
from .lm_score import op8_lm_score
from .merkle import OP12_SQL, op12_merkle
from .packing import op9_packing
from .quality import op7_quality
from .secrets import op4_secrets
from .simhash import op1_simhash
from .suffix_dedup import op10_suffix_dedup
from .token_output import op2_token_output
from .url_filter import op11_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_output": op2_token_output,
    "op3_language": op3_language,
    "op4_secrets": op4_secrets,
    "op5_decontaminate": op5_decontaminate,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_quality": op7_quality,
    "op8_lm_score": op8_lm_score,
    "op9_packing": op9_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_url_filter": op11_url_filter,
    "op12_merkle": op12_merkle,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {"op12_merkle": OP12_SQL, "op13_collocations": OP13_SQL}
