"""Queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op11_alignment
from .embedding_dedup import op7_embedding_dedup
from .exact_dedup import OP12_SQL, op12_exact_dedup
from .language_id import op10_language_id
from .licenses import op8_licenses
from .lm_scoring import op2_lm_scoring
from .near_dedup import op1_near_dedup
from .packing import op6_packing
from .pieces import op3_pieces
from .prefix_forest import op9_prefix_forest
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .toxicity import op5_toxicity
from .warc import OP4_SQL, op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_pieces": op3_pieces,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_licenses": op8_licenses,
    "op9_prefix_forest": op9_prefix_forest,
    "op10_language_id": op10_language_id,
    "op11_alignment": op11_alignment,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {"op4_warc": OP4_SQL, "op12_exact_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL}
