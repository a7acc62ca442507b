"""Operators over text corpora for training data. Nothing else in the library imports this."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality_rules", "ngram_lm", "secrets", "licenses", "quality_classifier", "packing", "token_files", "near_dedup", "toxicity", "decontamination", "nearest", "lexical_search", "resampling")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"{__name__}.{module}"), name)
    return out


def queries() -> dict:
    import corpus_pipeline

    return _gather("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    return _gather("ORACLE_SQL") | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
