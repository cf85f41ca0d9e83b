"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from . import conversation_repair, decontaminate, embedding_dups, exact_dedup, line_dedup, mixing, pii, quality, ranked_search, secret_scan, simhash, substring_dedup, toxicity


def queries():
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_personal_data": pii.op2_personal_data,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_quality_classifier": quality.op6_quality_classifier,
        "op7_embedding_near_dedup": embedding_dups.op7_embedding_near_dedup,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_ranked_search": ranked_search.op11_ranked_search,
        "op12_exact_dedup": exact_dedup.op12_exact_dedup,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    }


def oracle_sql():
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op3_secret_scan": secret_scan.op3_sql(),
        "op5_decontaminate": decontaminate.OP5_SQL,
        "op7_embedding_near_dedup": embedding_dups.OP7_SQL,
        "op8_mix_sources": mixing.OP8_SQL,
        "op9_substring_dedup": substring_dedup.OP9_SQL,
        "op11_ranked_search": ranked_search.OP11_SQL,
        "op12_exact_dedup": exact_dedup.OP12_SQL,
        "op13_conversation_repair": conversation_repair.OP13_SQL,
    }
