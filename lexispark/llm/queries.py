"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from lexispark.llm import bpe, chat, decontam, jaccard, licenses, lm, pii, quality, shards, suffix

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_licenses": licenses.op2_licenses,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_bpe": bpe.op4_bpe,
    "op5_lm": lm.op5_lm,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_pii": pii.op7_pii,
    "op8_chat": chat.op8_chat,
    "op9_shards": shards.op9_shards,
    "op10_suffix": suffix.op10_suffix,
}

ORACLE_SQL = {
    "op3_decontaminate": decontam.OP3_SQL,
    "op8_chat": chat.OP8_SQL,
}
