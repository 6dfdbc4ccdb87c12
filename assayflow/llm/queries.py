"""The corpus operators' queries, and their SQL where there is one."""

from __future__ import annotations

from assayflow.llm import exact_dedup, langid, licenses, line_dedup, mixing, near_dedup, packing, quality, sharding, warc

QUERIES = {
    "op1_hypergeometric_shards": sharding.op1_hypergeometric_shards,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_fuzzy_line_dedup": line_dedup.op5_fuzzy_line_dedup,
    "op6_warc_derivatives": warc.op6_warc_derivatives,
    "op7_order_minhash": near_dedup.op7_order_minhash,
    "op8_distribution_rules": quality.op8_distribution_rules,
    "op9_language_id": langid.op9_language_id,
    "op10_linear_grouping_packing": packing.op10_linear_grouping_packing,
}
ORACLE_SQL = {
    "op3_mix_sources": mixing.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
}
