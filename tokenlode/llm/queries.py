"""The queries of this subpackage and the SQL of those that have any."""

from __future__ import annotations

import importlib

#: Query -> its module, which may have SQL for it.
_MODULES = {
    "op1_sentencepiece": "sentencepiece_wfst",
    "op2_exact_dedup": "exact_dedup",
    "op3_sharding": "sharding",
    "op4_ngram_jaccard": "ngram_jaccard",
    "op5_line_dedup": "line_dedup",
    "op6_mixing": "mixing",
    "op7_chat_format": "chat",
    "op8_ann": "hilbert_ann",
    "op9_language_id": "language_id",
    "op10_pii": "pii",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{m}", __package__), name) for name, m in _MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(importlib.import_module(f".{m}", __package__), "SQL", None) for name, m in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
