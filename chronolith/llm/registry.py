"""Queries of the corpus operators and the SQL of those that DuckDB can express."""

from __future__ import annotations

from . import brown_lm, byte_bpe, decontaminate, exact_dedup, fill_middle, host_rules, licenses, line_dedup, ngram_join, quality, quotations, token_counts, vector_codes

QUERIES = {
    "op1_lm_scoring": brown_lm.query,
    "op2_decontamination": decontaminate.query,
    "op3_line_dedup": line_dedup.query,
    "op4_token_counts": token_counts.query,
    "op5_quotation_linking": quotations.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_license_scan": licenses.query,
    "op8_byte_bpe": byte_bpe.query,
    "op9_ngram_jaccard_join": ngram_join.query,
    "op10_quality_classifier": quality.query,
    "op11_vector_codes": vector_codes.query,
    "op12_host_rules": host_rules.query,
    "op13_fill_middle": fill_middle.query,
}
ORACLES = {"op6_exact_dedup": exact_dedup.ORACLE, "op7_license_scan": licenses.ORACLE, "op11_vector_codes": vector_codes.ORACLE, "op12_host_rules": host_rules.ORACLE, "op13_fill_middle": fill_middle.ORACLE}
