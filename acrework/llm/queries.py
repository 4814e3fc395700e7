"""The queries of this package by name; ``__spark_entry__`` adds them if the package can be imported."""

from __future__ import annotations

from acrework.llm.byte_bpe import op8_byte_bpe
from acrework.llm.html_extraction import OP13_SQL, op13_html_extraction
from acrework.llm.importance import op12_importance_resampling
from acrework.llm.language_id import op3_language_id
from acrework.llm.near_dedup import op4_near_dedup
from acrework.llm.neighbours import op5_nearest_neighbours
from acrework.llm.packing import op6_packing
from acrework.llm.quality_rules import op10_quality_rules
from acrework.llm.secrets import op2_secret_scan
from acrework.llm.spelling_variants import op11_spelling_variants
from acrework.llm.suffix_dedup import op9_suffix_dedup
from acrework.llm.token_files import op7_token_files
from acrework.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_language_id": op3_language_id,
    "op4_near_dedup": op4_near_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_packing": op6_packing,
    "op7_token_files": op7_token_files,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_html_extraction": op13_html_extraction,
}

#: The others have no exact meaning in SQL; tests compare them with brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {"op13_html_extraction": OP13_SQL}
