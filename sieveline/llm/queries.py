"""The training-data queries and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op4_decontamination
from .jaccard_join import op6_jaccard_join
from .language_id import op2_language_id
from .packing import instruction_packing, op10_packing
from .pii import op8_pii
from .prefix_trie import SQL as SQL_13
from .prefix_trie import op13_prefix_trie
from .quality import op9_quality_rules
from .repeats import SQL as SQL_7
from .repeats import op7_repeats
from .token_counts import op1_token_counts
from .token_files import op3_token_files
from .top_k import SQL as SQL_12
from .top_k import op12_top_k
from .vector_codes import SQL as SQL_11
from .vector_codes import op11_vector_codes
from .warc import SQL as SQL_5
from .warc import op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_language_id": op2_language_id,
        "op3_token_files": op3_token_files,
        "op4_decontamination": op4_decontamination,
        "op5_warc": op5_warc,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_repeats": op7_repeats,
        "op8_pii": op8_pii,
        "op9_quality_rules": op9_quality_rules,
        "op10_packing": op10_packing,
        "instruction_packing": instruction_packing,
        "op11_vector_codes": op11_vector_codes,
        "op12_top_k": op12_top_k,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    """Models, tokenizers and MinHash can't be put in SQL; tests hold those queries against plain versions."""
    return {"op5_warc": SQL_5, "op7_repeats": SQL_7, "op11_vector_codes": SQL_11, "op12_top_k": SQL_12, "op13_prefix_trie": SQL_13}
