"""The training-data queries and their SQL."""

from __future__ import annotations

from maskmix.llm import bpe, lm, media, mixing, neardup, pii, quality, repeats, toxicity, urls

QUERIES = {
    "op1_disclosure": pii.op1_disclosure,
    "op2_toxicity_chain": toxicity.op2_toxicity_chain,
    "op3_url_rules": urls.op3_url_rules,
    "op4_gated_lm": lm.op4_gated_lm,
    "op5_repeated_phrases": repeats.op5_repeated_phrases,
    "op6_host_rules": quality.op6_host_rules,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_fast_similarity": neardup.op8_fast_similarity,
    "op9_curriculum_mix": mixing.op9_curriculum_mix,
    "op10_mpeg_audio": media.op10_mpeg_audio,
}

#: The others are not expressible in SQL; tests/llm holds them against plain Python.
ORACLES = {
    "op3_url_rules": urls.ORACLE,
    "op5_repeated_phrases": repeats.ORACLE,
    "op6_host_rules": quality.ORACLE,
    "op8_fast_similarity": neardup.ORACLE,
    "op9_curriculum_mix": mixing.ORACLE,
}
