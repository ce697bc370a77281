"""The training-data queries and, where SQL can express them, their DuckDB equivalents."""

from . import bpe, decontam, html, jaccard, langid, linededup, merkle, ppm, quality, sharding, spelling, substring, tokenbin

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_quality_rules": quality.op5_quality_rules,
    "quality_ablation": quality.quality_ablation,
    "op6_sharding": sharding.op6_sharding,
    "op7_token_binary": tokenbin.op7_token_binary,
    "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
    "op9_html_extraction": html.op9_html_extraction,
    "op10_substring_dedup": substring.op10_substring_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_ppm_score": ppm.op12_ppm_score,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {
    "op4_line_dedup": linededup.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "quality_ablation": quality.ABLATION_ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
