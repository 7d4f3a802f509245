"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, html_extract, importance, jaccard_join, keyed_upsert, line_dedup, mixing, suffix_dedup, token_output, toxicity, url_filter

_OPS = {
    "op1_jaccard_join": jaccard_join,
    "op2_mixing": mixing,
    "op3_line_dedup": line_dedup,
    "op4_suffix_dedup": suffix_dedup,
    "op5_toxicity": toxicity,
    "op6_decontaminate": decontaminate,
    "op7_chat_format": chat_format,
    "op8_html_extract": html_extract,
    "op9_exact_dedup": exact_dedup,
    "op10_token_output": token_output,
    "op11_url_filter": url_filter,
    "op12_importance": importance,
    "op13_keyed_upsert": keyed_upsert,
}


def queries() -> dict:
    return {name: module.query for name, module in _OPS.items()}


def oracle_sql() -> dict:
    return {name: module.SQL for name, module in _OPS.items() if getattr(module, "SQL", None)}
