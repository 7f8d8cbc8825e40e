"""Registered queries: name -> Spark callable, and name -> DuckDB text."""

from __future__ import annotations

from importlib import import_module

GROUPS = (
    "tables", "cleaning", "passages", "similarity", "search", "evidence",
    "grounding", "analytics", "bookkeeping", "export", "streams", "extras",
)


def load():
    spark_queries, duck_queries = {}, {}
    for group in GROUPS:
        module = import_module(f"{__name__}.{group}")
        for name, (fn, text) in module.QUERIES.items():
            spark_queries[name] = fn
            if text:
                duck_queries[name] = text
    return spark_queries, duck_queries
