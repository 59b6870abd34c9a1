"""Queries of the training-data operators, and the SQL that some of them can be compared with."""

from __future__ import annotations

from .exact_dedup import OP9_SQL, op9_exact_dedup
from .importance import OP11_SQL, op11_importance
from .language_id import op10_language_id
from .language_model import op8_cross_entropy
from .mixing import op4_mixing
from .near_dedup import OP3_SQL, op3_near_dedup
from .negatives import OP12_SQL, op12_hard_negatives
from .neighbours import op7_nearest_neighbours
from .packing import op5_packing
from .records import op2_token_records
from .repeats import op1_suffix_dedup
from .token_counts import op13_token_counts
from .toxicity import op6_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_records": op2_token_records,
    "op3_near_dedup": op3_near_dedup,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_cross_entropy": op8_cross_entropy,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_importance": op11_importance,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL = {"op3_near_dedup": OP3_SQL, "op9_exact_dedup": OP9_SQL, "op11_importance": OP11_SQL, "op12_hard_negatives": OP12_SQL}
