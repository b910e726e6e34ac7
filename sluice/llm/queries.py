"""The operators' queries and their SQL, for the entry module."""

from __future__ import annotations

from sluice.llm import binary_search, line_dedup, mixing, near_dups, pii, quality, sentencepiece_op, suffix_tree, token_files, toxicity

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_sentencepiece": sentencepiece_op.op3_sentencepiece,
    "op4_near_dups": near_dups.op4_near_dups,
    "op5_binary_top_k": binary_search.op5_binary_top_k,
    "op6_token_files": token_files.op6_token_files,
    "op7_pii": pii.op7_pii,
    "op8_lm_scores": suffix_tree.op8_lm_scores,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

#: The others have no SQL form (seeded selection, learned models, files); their tests hold them against brute force.
SQL = {
    "op2_quality_rules": quality.OP2_SQL,
    "op5_binary_top_k": binary_search.OP5_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
