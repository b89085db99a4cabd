"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import chat, compression, contamination, html_text, language, lm_score, merkle, mix, set_join, shard, simhash, tokens, whitening

QUERIES = {
    "op1_bitplanes": tokens.op1_bitplanes,
    "op2_mix": mix.op2_mix,
    "op3_chat": chat.op3_chat,
    "op4_compression": compression.op4_compression,
    "op5_feistel": shard.op5_feistel,
    "op6_cross_entropy": lm_score.op6_cross_entropy,
    "op7_language": language.op7_language,
    "op8_contamination": contamination.op8_contamination,
    "op9_style_tree": html_text.op9_style_tree,
    "op10_jaccard": set_join.op10_jaccard,
    "op11_merkle": merkle.op11_merkle,
    "op12_simhash": simhash.op12_simhash,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL = {
    "op2_mix": mix.ORACLE,
    "op3_chat": chat.ORACLE,
    "op8_contamination": contamination.ORACLE,
    "op10_jaccard": set_join.ORACLE,
    "op11_merkle": merkle.ORACLE,
}
