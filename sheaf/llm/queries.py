"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from sheaf.llm import archive, decontam, extraction, filters, fingerprints, langid, licenses, neardup, packing, quality, secrets, tokens, whitening

QUERIES: dict[str, Callable] = {
    "op1_fingerprints": fingerprints.op1,
    "op3_token_ids": tokens.op3,
    "op2_licenses": licenses.op2,
    "op4_secrets": secrets.op4,
    "op5_packing": packing.op5,
    "op6_language_id": langid.op6,
    "op7_near_duplicates": neardup.op7,
    "op8_warc": archive.op8,
    "op9_decontamination": decontam.op9,
    "op10_quality": quality.op10,
    "op11_main_text": extraction.op11,
    "op12_filter_audit": filters.op12,
    "op13_whitening": whitening.op13,
}

ORACLE: dict[str, str] = {
    "op7_near_duplicates": neardup.ORACLE,
    "op8_warc": archive.ORACLE,
    "op9_decontamination": decontam.ORACLE,
    "op11_main_text": extraction.ORACLE,
    "op12_filter_audit": filters.ORACLE,
}
