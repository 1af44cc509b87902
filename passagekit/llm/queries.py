"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from passagekit.llm import (
    bpe,
    chat,
    html_text,
    packing,
    pii,
    quality_model,
    quality_rules,
    simhash,
    suffix_tree,
    topk,
    toxicity,
    turn_repair,
    whitening,
)

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_quality_rules": quality_rules.query,
    "op3_suffix_tree_scores": suffix_tree.query,
    "op4_bpe": bpe.query,
    "op5_quality_classifier": quality_model.query,
    "op6_exact_top_k": topk.query,
    "op7_html_extraction": html_text.query,
    "op8_chat_formatting": chat.query,
    "op9_pii": pii.query,
    "op10_simhash_near_dedup": simhash.query,
    "op11_toxicity": toxicity.query,
    "op12_turn_repair": turn_repair.query,
    "op13_embedding_whitening": whitening.query,
}

CHECKS = {
    "op6_exact_top_k": topk.CHECK,
    "op8_chat_formatting": chat.CHECK,
}
