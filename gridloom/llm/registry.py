"""The operators' queries and SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, mixing, packing, pii, quality, simhash, substring, topk, toxicity


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_simhash": simhash.op2_simhash,
        "op3_packing": packing.op3_packing,
        "op4_chat": chat.op4_chat,
        "op5_quality": quality.op5_quality,
        "op6_mixing": mixing.op6_mixing,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_substring": substring.op8_substring,
        "op9_pii": pii.op9_pii,
        "op10_topk": topk.op10_topk,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
        "op1_decontaminate": decontaminate.ORACLE,
        "op4_chat": chat.ORACLE,
        "op10_topk": topk.ORACLE,
    }
