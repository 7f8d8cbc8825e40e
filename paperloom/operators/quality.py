"""Constraint audit of the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.defaults import CONCEPT_TYPES, JOB_STATES, PROCESSING_STATES, READING_STATES


def one_of(column: str, values) -> Column:
    return F.col(column).isin(*values)


def row_rules() -> dict[str, dict[str, Column]]:
    """Accepting condition per rule and table."""
    return {
        "papers": {
            "papers_processing_status": one_of("processing_status", PROCESSING_STATES),
            "papers_reading_status": one_of("reading_status", READING_STATES),
        },
        "jobs": {
            "jobs_status": one_of("status", JOB_STATES),
            "jobs_progress": F.col("progress").between(0, 100),
        },
        "concepts": {"concepts_type": one_of("concept_type", CONCEPT_TYPES)},
    }


def check_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations of every row rule in one pass; null passes, as in a CHECK."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def duplicate_keys(df: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    """Rows beyond the first per unique key; keys with a null part are not compared."""
    full = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return full.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def orphans(child: DataFrame, parent: DataFrame, rule: str, key: str) -> DataFrame:
    lost = child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def audit(tables: dict[str, DataFrame], unique: dict[str, tuple[str, list[str]]], foreign: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(rule, violations) for all checks.

    ``unique``: rule -> (table, keys). ``foreign``: rule -> (child, parent, key).
    """
    parts = [check_rows(tables[t], rules) for t, rules in row_rules().items() if t in tables]
    parts += [duplicate_keys(tables[t], rule, keys) for rule, (t, keys) in unique.items()]
    parts += [orphans(tables[c], tables[p], rule, key) for rule, (c, p, key) in foreign.items()]
    return reduce(DataFrame.unionByName, parts)
