"""The queries of this folder: one per operator, each over its whole table."""

from __future__ import annotations

from veilscan.llm import (
    decontam, exact, langid, lines, mixing, pii, quality, repair, resampling, simhash, substrings, templates,
    topk,
)

QUERIES = {
    "op1_pii": pii.query,
    "op2_decontamination": decontam.query,
    "op3_exact_dedup": exact.query,
    "op4_mixing": mixing.query,
    "op5_quality": quality.query,
    "op6_simhash": simhash.query,
    "op7_language_id": langid.query,
    "op8_substrings": substrings.query,
    "op9_html": templates.query,
    "op10_lines": lines.query,
    "op11_resampling": resampling.query,
    "op12_topk": topk.query,
    "op13_repair": repair.query,
}

SQL = {
    "op3_exact_dedup": exact.SQL,
    "op4_mixing": mixing.SQL,
    "op11_resampling": resampling.SQL,
    "op12_topk": topk.SQL,
    "op13_repair": repair.SQL,
}
