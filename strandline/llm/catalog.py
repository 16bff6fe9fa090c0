"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Query, module, SQL constant or None.
ENTRIES = (
    ("op1_substring_dedup", "substrings", "OP1_SQL"),
    ("op2_gif", "gif", None),
    ("op3_jaccard_join", "jaccard", "OP3_SQL"),
    ("op4_mix", "mixing", "OP4_SQL"),
    ("op5_katz", "katz", None),
    ("op6_quality", "quality", None),
    ("op7_licenses", "licenses", None),
    ("op8_imi", "imi", None),
    ("op9_sentencepiece", "pieces", None),
    ("op10_warc", "warc", "OP10_SQL"),
)


def queries():
    import corpus_pipeline

    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module, _ in ENTRIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), sql) for name, module, sql in ENTRIES if sql}
