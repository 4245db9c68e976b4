"""Operators of a large-scale training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Modules that register queries, by the operators' numbers.
MODULES = ("banded", "chat", "lattice", "media", "minhash", "packing", "phrases", "ranking", "sentence_pieces", "simhash", "site_tree", "suffix_dedup", "toxicity")


def queries() -> dict:
    out = {}
    for m in MODULES:
        out |= import_module(f"{__name__}.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in MODULES:
        out |= import_module(f"{__name__}.{m}").ORACLES
    return out
