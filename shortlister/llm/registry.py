"""Queries of the corpus operators and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

#: Query name, module of this package and function in it.
_OPERATORS = (
    ("op1_ngram_jaccard_join", "jaccard", "op1"),
    ("op2_patience_line_dedup", "linedup", "op2"),
    ("op3_toxicity_weak_supervision", "toxicity", "op3"),
    ("op4_winnowing_fingerprints", "winnow", "op4"),
    ("op5_feistel_shards", "feistel", "op5"),
    ("op6_warc_splittable", "warc", "op6"),
    ("op7_vector_packing", "pack", "op7"),
    ("op8_curriculum_mix", "mix", "op8"),
    ("op9_impact_ordered_top_k", "topk", "op9"),
    ("op10_preference_chat", "chat", "op10"),
)


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), function) for name, module, function in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    found = ((name, getattr(import_module(f"{__package__}.{module}"), "ORACLE", None)) for name, module, _ in _OPERATORS)
    return {name: sql for name, sql in found if sql}
