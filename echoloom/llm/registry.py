"""The queries of the training-data operators and, where SQL can state them, their oracles."""

from __future__ import annotations

from importlib import import_module

MODULES = ("split_oversized", "similar_vectors", "similarity_clusters", "sentences", "shared_spans", "near_duplicates", "packing", "leakage", "abuse")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _m = import_module(f"echoloom.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
