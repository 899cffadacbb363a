"""The registered queries of this subpackage and their DuckDB text."""

from __future__ import annotations

from pizarra.llm import bpe, chat_format, divergence, exact_dedup, language_id, mixing, ngram_join, packing, pii, quality, spelling, suffix_dedup, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_bpe": bpe.op5_bpe,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_packing": packing.op7_packing,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_language_id": language_id.op9_language_id,
    "op10_pii": pii.op10_pii,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_divergence": divergence.op12_divergence,
    "op13_mixing": mixing.op13_mixing,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op4_chat_format": chat_format.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_mixing": mixing.ORACLE,
}
