"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    byte_bpe,
    collocations,
    context_mixing,
    decontamination,
    exact_dedup,
    language_gru,
    pairwise_quality,
    parity_join,
    slack_packing,
    substring_index,
    token_records,
    url_rules,
    vector_codes,
)

QUERIES = {
    "op1_context_mixing": context_mixing.op1_context_mixing,
    "op2_language_gru": language_gru.op2_language_gru,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_pairwise_quality": pairwise_quality.op5_pairwise_quality,
    "op6_parity_join": parity_join.op6_parity_join,
    "op7_url_rules": url_rules.op7_url_rules,
    "op8_token_records": token_records.op8_token_records,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_substring_dedup": substring_index.op10_substring_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_slack_packing": slack_packing.op12_slack_packing,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
