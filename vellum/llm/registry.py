"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from vellum.llm import chat, decontaminate, licenses, lines, minhash, ngram, pieces, quality, suffix, urls


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_suffix_dedup": suffix.op3_suffix_dedup,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_license_scans": licenses.op5_license_scans,
        "op6_lm_scoring": ngram.op6_lm_scoring,
        "op7_url_filters": urls.op7_url_filters,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_chat_formatting": chat.op9_chat_formatting,
        "op10_minhash": minhash.op10_minhash,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    found = {"op7_url_filters": urls.oracle()}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
