"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from . import chat_format, decontaminate, host_rules, line_dedup, near_dedup, packing, pitman_yor, quality_classifier, suffix_dedup, token_counts

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_pitman_yor": pitman_yor.op2_pitman_yor,
    "op3_host_rules": host_rules.op3_host_rules,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}
ORACLES = {
    "op1_chat_format": chat_format.ORACLE,
    "op3_host_rules": host_rules.ORACLE,
}
