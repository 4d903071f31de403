"""The queries of the text operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from gridloom.llm import exact_dedup, fingerprints, language_id, line_templates, manifest, media, mixing, packing, simhash, suffix_dedup, suffix_tree, token_counts, whitening

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_mixing": mixing.op2_mixing,
    "op3_media_columns": media.op3_media_columns,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_packing": packing.op5_packing,
    "op6_line_dedup": line_templates.op6_line_dedup,
    "op7_suffix_tree_scores": suffix_tree.op7_suffix_tree_scores,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_document_fingerprints": fingerprints.op11_document_fingerprints,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}
ORACLES = {"op10_exact_dedup": exact_dedup.SQL, "op13_merkle_manifest": manifest.SQL}
