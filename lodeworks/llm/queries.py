"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, jaccard, language, packing, passages, pieces, quality, records, repair, sharding, topk, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_language_id": language.op2_language_id,
    "op3_binary_records": records.op3_binary_records,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_sharding": sharding.op7_sharding,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_substring_dedup": passages.op10_substring_dedup,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
}
SQL = {"op1_url_filter": url_filter.SQL, "op4_quality_rules": quality.SQL, "op8_exact_topk": topk.SQL}
