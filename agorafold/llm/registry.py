"""The training-data queries and their DuckDB counterparts."""

from __future__ import annotations

import corpus_pipeline
from agorafold.llm import chat_format, decontaminate, html_extract, minhash, mixing, quality_cnn, quality_rules, sharding, substring_dedup, token_counts, toxicity, vector_codes, whitening


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_html_extract": html_extract.op4_html_extract,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_sharding": sharding.op8_sharding,
        "op9_minhash": minhash.op9_minhash,
        "op10_mixing": mixing.op10_mixing,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_quality": quality_cnn.op12_quality,
        "op13_whitening": whitening.op13_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontaminate.OP2_SQL,
        "op3_chat_format": chat_format.OP3_SQL,
        "op5_quality_rules": quality_rules.OP5_SQL,
        "op6_substring_dedup": substring_dedup.OP6_SQL,
        "op9_minhash": minhash.OP9_SQL,
        "op10_mixing": mixing.OP10_SQL,
        "op11_vector_codes": vector_codes.OP11_SQL,
    }
