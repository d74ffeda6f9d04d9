"""The registered queries of the subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from veilframe.llm.queries_alignment import op13_aligned_tokens
from veilframe.llm.queries_duplicates import op6_phrase_repeats, op10_anchor_simhash
from veilframe.llm.queries_lines import OP12_SQL, op12_line_bitmaps
from veilframe.llm.queries_pages import op5_layout_text, op8_co_trained_quality
from veilframe.llm.queries_planning import op2_table_sharding, op3_low_discrepancy_mix
from veilframe.llm.queries_tokens import op1_token_files, op9_best_fit_packing
from veilframe.llm.queries_vectors import OP4_SQL, OP7_SQL, op4_pca_near_vectors, op7_histogram_top_k, op11_qd_whitening

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_table_sharding": op2_table_sharding,
    "op3_low_discrepancy_mix": op3_low_discrepancy_mix,
    "op4_pca_near_vectors": op4_pca_near_vectors,
    "op5_layout_text": op5_layout_text,
    "op6_phrase_repeats": op6_phrase_repeats,
    "op7_histogram_top_k": op7_histogram_top_k,
    "op8_co_trained_quality": op8_co_trained_quality,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_anchor_simhash": op10_anchor_simhash,
    "op11_qd_whitening": op11_qd_whitening,
    "op12_line_bitmaps": op12_line_bitmaps,
    "op13_aligned_tokens": op13_aligned_tokens,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op4_pca_near_vectors": OP4_SQL,
    "op7_histogram_top_k": OP7_SQL,
    "op12_line_bitmaps": OP12_SQL,
}
