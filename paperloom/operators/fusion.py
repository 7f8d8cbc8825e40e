"""Hybrid ranking, retrieval evaluation, growth and tier mix (M1, M2, M4, M5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.defaults import TASK_TIER

RRF_OFFSET = 60


def fuse_rankings(vector: DataFrame, keyword: DataFrame, limit: int = 20, offset: int = RRF_OFFSET) -> DataFrame:
    """M1: reciprocal-rank fusion of two rankings (query_id, chunk_id, rank)."""
    a = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"))
    b = keyword.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"))
    part = lambda c: F.coalesce(1 / (F.lit(float(offset)) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query_id", "chunk_id"], "full").withColumn("fused", F.round(part("vector_rank") + part("keyword_rank"), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "chunk_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def recall_at(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """M2: share of the relevant passages (query_id, chunk_id) among the first k hits."""
    found = relevant.join(hits.filter(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left")
    return found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("relevant"), F.count("_hit").alias("found"), (F.count("_hit") / F.count(F.lit(1))).alias("recall")
    )


def library_growth(papers: DataFrame, unit: str = "month") -> DataFrame:
    """M4: papers added per user and period, and the running total."""
    added = papers.groupBy("user_id", F.date_trunc(unit, "created_at").alias("period")).agg(F.count(F.lit(1)).alias("added"))
    # Periods of one user: counts, not papers.
    order = Window.partitionBy("user_id").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return added.withColumn("total", F.sum("added").over(order))


def tier_mix(analyses: DataFrame) -> DataFrame:
    """M5: stored analyses by task tier, provider and model."""
    tiers = analyses.sparkSession.createDataFrame(list(TASK_TIER.items()), "task string, tier string")
    task = F.when(F.col("analysis_type") == "concepts", "keyword_extraction").otherwise(F.col("analysis_type"))
    named = analyses.withColumn("task", task).join(F.broadcast(tiers), "task", "left")
    return named.groupBy("tier", "provider", "model_id").agg(F.count(F.lit(1)).alias("analyses"))
