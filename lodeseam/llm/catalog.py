"""Queries of this subpackage, by name, and the SQL that states their results."""

from __future__ import annotations

import importlib

#: module, query, name of its SQL (None: tested against brute force)
_QUERIES = [
    ("substrings", "op1_substring_dedup", "SQL"),
    ("lines", "op2_line_dedup", None),
    ("quality", "op3_quality", None),
    ("warc", "op4_warc_roundtrip", "SQL"),
    ("neighbours", "op6_nearest", None),
    ("decontaminate", "op7_decontaminate", "SQL"),
    ("packing", "op8_pack", None),
    ("order_minhash", "op9_near_duplicates", None),
    ("token_counts", "op10_token_counts", None),
    ("chat", "op5_chat_format", "SQL"),
    ("periodic_runs", "op11_periodic_runs", None),
    ("license_scan", "op12_license_scan", None),
    ("hard_negatives", "op13_hard_negatives", "SQL"),
]


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": _pipeline} | {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for module, name, _ in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), sql) for module, name, sql in _QUERIES if sql}
