"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, fill_in_middle, merkle, mixing, near_dedup, pii, quality, sharding, substring_dedup, token_counts, toxicity, url_filter, warc

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_warc": warc.op3_warc,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_sharding": sharding.op9_sharding,
    "op10_pii": pii.op10_pii,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_merkle": merkle.op13_merkle,
}
ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": near_dedup.OP1_SQL,
    "op2_decontamination": decontaminate.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op9_sharding": sharding.OP9_SQL,
    "op11_fill_in_middle": fill_in_middle.OP11_SQL,
    "op12_url_filter": url_filter.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
