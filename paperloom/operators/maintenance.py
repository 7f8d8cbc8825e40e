"""Set forms of inserts, replacements and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import has_text


def replace_rows(old: DataFrame, new: DataFrame, key: str = "paper_id") -> DataFrame:
    """Keys present in ``new`` lose their old rows and get the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``; combined map-side, safe for hot keys."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in rows.columns])


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key is new, once each, after the stored ones."""
    fresh = first_per_key(rows, keys, order).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def upsert_results(stored: DataFrame, fresh: DataFrame, *, refresh: bool = False) -> DataFrame:
    """One result per (user_id, cache_key); the first committed row wins.

    With ``refresh`` a fresh result takes the place of the stored one.
    """
    old_rank, new_rank = (1, 0) if refresh else (0, 1)
    both = stored.withColumn("_p", F.lit(old_rank)).unionByName(fresh.withColumn("_p", F.lit(new_rank)))
    return first_per_key(both, ["user_id", "cache_key"], ["_p", "created_at", "analysis_id"]).drop("_p")


def delete_papers(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """A10: deleting papers takes sections, passages, concepts, jobs and analyses along.

    ``tables`` maps a name to a table with ``paper_id``; rows without a paper stay.
    """
    gone = doomed.select("paper_id").distinct()
    return {name: df.join(gone, "paper_id", "left_anti") for name, df in tables.items()}


def delete_projects(papers: DataFrame, analyses: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A10: deleting projects (user_id, project_id) drops their analyses and releases their papers.

    Returns papers, analyses and the number of papers released per project.
    """
    gone = doomed.select("user_id", "project_id").distinct()
    marked = papers.join(gone.withColumn("_gone", F.lit(True)), ["user_id", "project_id"], "left")
    project = F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("project_id"))
    kept = marked.withColumn("project_id", project).drop("_gone").select(*papers.columns)
    released = gone.join(
        papers.groupBy("user_id", "project_id").agg(F.count(F.lit(1)).alias("released")), ["user_id", "project_id"], "left"
    ).withColumn("released", F.coalesce("released", F.lit(0)))
    return kept, analyses.join(gone, ["user_id", "project_id"], "left_anti"), released


def import_catalogue(requests: DataFrame, papers: DataFrame) -> DataFrame:
    """Catalogue records as metadata-only papers; known ones are refused.

    ``requests``: user_id, project_id, external_id, title, authors, position, ...;
    ``papers``: user_id, project_id, external_id. A record asked for twice in one
    batch is taken once.
    """
    named = requests.filter(has_text(F.col("external_id")))
    unnamed = requests.filter(~has_text(F.col("external_id")))
    once = first_per_key(named, ["user_id", "project_id", "external_id"], ["position"])
    known = papers.select("user_id", "project_id", "external_id").distinct().withColumn("_known", F.lit(True))
    joined = once.join(known, ["user_id", "project_id", "external_id"], "left").unionByName(
        unnamed.withColumn("_known", F.lit(None).cast("boolean"))
    )
    authors = F.array_sort(F.filter("authors", has_text))
    return joined.select(
        *[c for c in requests.columns if c not in ("title", "authors")],
        F.when(has_text(F.col("title")), F.col("title")).otherwise("Untitled paper").alias("title"),
        authors.alias("authors"),
        F.when(F.col("_known"), F.lit(None)).otherwise(F.lit("metadata_only")).alias("processing_status"),
        F.when(F.col("_known"), "DUPLICATE_PAPER").alias("reject_code"),
    )
