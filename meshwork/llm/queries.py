"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import decontamination, exact_dedup, fingerprint, language_id, lm_score, packing, quality, resampling, sentencepiece, simhash, substring_dedup, url_filter, whitening

QUERIES = {
    "op1_fingerprint": fingerprint.op1_fingerprint,
    "op2_sentencepiece": sentencepiece.op2_sentencepiece,
    "op3_packing": packing.op3_packing,
    "op4_simhash": simhash.op4_simhash,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_quality": quality.op7_quality,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_benchmark_decontamination": decontamination.op12_benchmark_decontamination,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}
SQL = {
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op12_benchmark_decontamination": decontamination.OP12_SQL,
    "op13_importance_resampling": resampling.OP13_SQL,
}
