"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import divergence, fingerprint, katz, language, mixing, ngram_join, packing, quality, separators, token_files, topk, toxicity, vector_codes

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_token_counts": separators.op3_token_counts,
    "op4_orc_tokens": token_files.op4_orc_tokens,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_quality": quality.op6_quality,
    "op7_mixing": mixing.op7_mixing,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_topk": topk.op10_topk,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_katz_scores": katz.op13_katz_scores,
}

ORACLES = {
    "op5_ngram_join": ngram_join.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op10_topk": topk.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
}
