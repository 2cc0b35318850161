"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from perkloom.llm import (
    bpe, exact_dedup, lm_scoring, mixing, phrases, pii, quality, secret_scan, simhash, token_counts,
    toxicity, whitening, winnowing,
)

QUERIES = {
    "op1_winnowing": winnowing.op1_winnowing,
    "op2_simhash": simhash.op2_simhash,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_pii": pii.op4_pii,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_bpe": bpe.op6_bpe,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality": quality.op8_quality,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_phrases": phrases.op12_phrases,
    "op13_secrets": secret_scan.op13_secrets,
}
ORACLE = {"op10_exact_dedup": exact_dedup.ORACLE, "op12_phrases": phrases.ORACLE}
