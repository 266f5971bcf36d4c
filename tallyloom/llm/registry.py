"""Queries and SQL of the numbered operators and of the pipeline."""

from __future__ import annotations

from tallyloom.llm import bpe, conversation_repair, edit_fingerprint, fill_middle, line_dedup, near_dedup, packing, pii, quality_cnn, quality_rules, sharding, top_search, toxicity

QUERIES: dict = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_pii": pii.op4_pii,
    "op5_sharding": sharding.op5_sharding,
    "op6_fingerprint": edit_fingerprint.op6_fingerprint,
    "op7_packing": packing.op7_packing,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_bpe": bpe.op9_bpe,
    "op10_quality_classifier": quality_cnn.op10_quality_classifier,
    "op11_top_search": top_search.op11_top_search,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
}
ORACLE: dict = {
    "op2_near_dedup": near_dedup.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_pii": pii.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op11_top_search": top_search.ORACLE,
    "op13_fill_in_middle": fill_middle.ORACLE,
}
