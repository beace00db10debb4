"""The corpus operators as queries over the whole tables, and their SQL where it exists."""

from __future__ import annotations

from cellweave.llm import bpe, divergence, html_extract, jaccard_join, lm_scoring, manifest, media, merkle, mixing, quality, secrets, suffix_dedup, token_counts

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
    "op5_suffix_array_dedup": suffix_dedup.op5_suffix_array_dedup,
    "op6_document_fingerprints": merkle.op6_document_fingerprints,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_html_extraction": html_extract.op9_html_extraction,
    "op10_media_columns": media.op10_media_columns,
    "op11_dataset_manifest": manifest.op11_dataset_manifest,
    "op12_lm_scoring": lm_scoring.op12_lm_scoring,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES = {
    "op7_source_mixing": mixing.ORACLE,
    "op11_dataset_manifest": manifest.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
