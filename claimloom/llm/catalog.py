"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from claimloom.llm import ann, language, mixing, neardup, packing, quotelinks, resampling, search, suffixdedup, toxicity

QUERIES = {
    "op1_quote_linking": quotelinks.op1_quote_linking,
    "op2_suffix_dedup": suffixdedup.op2_suffix_dedup,
    "op3_nearest_vectors": ann.op3_nearest_vectors,
    "op4_quality_resampling": resampling.op4_quality_resampling,
    "op5_language_id": language.op5_language_id,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_bm25_block_max": search.op7_bm25_block_max,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_pack_best_fit": packing.op10_pack_best_fit,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op2_suffix_dedup": suffixdedup.OP2_SQL,
    "op6_near_duplicates": neardup.OP6_SQL,
    "op7_bm25_block_max": search.OP7_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
