"""Saved queries as the index, arriving passages as its probes (M3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.keyword import terms
from ..operators.vector_cells import CELL_ROWS, _bounds, _visit, store_cells
from ..session import materialise
from ..sources.versions import append_version
from .jobs import drop_staged

#: More rows than a cell holds: every saved query of a cell may answer.
ALL = 1 << 30


def store_saved(saved: DataFrame, path: str, *, cell_rows: int = CELL_ROWS) -> None:
    """Write ``saved`` (query_id, user_id, embedding, text) as an index.

    Vectors lie in cells with exact bounds. Words lie under that stem of a query
    which the fewest saved queries of its owner hold; equal counts go by the
    stem. A query may have a vector, a text or both.
    """
    vectors = saved.filter("embedding IS NOT NULL").select(F.col("query_id").alias("chunk_id"), "user_id", "embedding")
    store_cells(vectors, f"{path}/vectors", cell_rows=cell_rows)
    asked = saved.select("query_id", "user_id", terms(F.coalesce("text", F.lit(""))).alias("terms")).filter(F.size("terms") > 0)
    asked = materialise(asked, "saved")
    held = asked.select("user_id", F.explode("terms").alias("term")).groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("held"))
    rare = asked.select("query_id", "user_id", F.explode("terms").alias("term")).join(held, ["user_id", "term"]).groupBy(
        "query_id", "user_id").agg(F.min_by("term", F.struct("held", "term")).alias("term"))
    asked.join(rare, ["query_id", "user_id"]).write.parquet(f"{path}/words")


def vector_alerts(spark: SparkSession, path: str, passages: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, similarity) of passages that reach ``floor``, and (pairs, all_pairs) as one row of counts.

    A passage looks only into cells whose cap reaches the floor; ``pairs`` counts
    what it met there, ``all_pairs`` what a join by owner would have met.
    """
    probes = materialise(passages.filter(F.exists("embedding", lambda x: x != 0)).select(
        F.col("chunk_id").alias("probe_id"), "user_id", "embedding", F.lit(ALL).alias("top_k"),
        F.lit(float(floor)).alias("floor"), F.lit(float(floor)).alias("score")), "arrived")
    caps = spark.read.parquet(f"{path}/vectors/caps")
    rows = spark.read.parquet(f"{path}/vectors/rows")
    visits = materialise(_bounds(caps, probes, 1.0, "beating"), "visits")
    schema = StructType([StructField("probe_id", probes.schema["probe_id"].dataType), StructField("chunk_id", rows.schema["chunk_id"].dataType),
                         StructField("similarity", DoubleType()), StructField("score", DoubleType())])
    found = _visit(rows, visits, probes.drop("score"), schema, 1.0)
    met = visits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    every = probes.groupBy("user_id").agg(F.count(F.lit(1)).alias("a")).join(
        caps.groupBy("user_id").agg(F.sum("n").alias("b")), "user_id").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("all_pairs"))
    return found.select(F.col("chunk_id").alias("query_id"), F.col("probe_id").alias("chunk_id"), "similarity"), met.crossJoin(every)


def keyword_alerts(spark: SparkSession, path: str, passages: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of passages that hold every stem of a saved query of their owner.

    Each stem of a passage meets the saved queries that lie under it; only these
    are compared with the rest of the passage.
    """
    saved = spark.read.parquet(f"{path}/words").withColumnRenamed("terms", "wanted")
    read = passages.select("chunk_id", "user_id", terms(F.col("content")).alias("held"))
    met = read.select("chunk_id", "user_id", "held", F.explode("held").alias("term")).join(saved, ["user_id", "term"])
    return met.filter(F.size(F.array_except("wanted", "held")) == 0).select("query_id", "chunk_id")


def alerts(spark: SparkSession, path: str, passages: DataFrame, floor: float) -> DataFrame:
    """(query_id, chunk_id, similarity, by_words): what a batch of passages (chunk_id, user_id, embedding, content) sets off."""
    near, _ = vector_alerts(spark, path, passages, floor)
    worded = keyword_alerts(spark, path, passages).withColumn("by_words", F.lit(True))
    return near.join(worded, ["query_id", "chunk_id"], "full").select(
        "query_id", "chunk_id", "similarity", F.coalesce("by_words", F.lit(False)).alias("by_words"))


def alert_stream(passages: DataFrame, path: str, table: str, checkpoint: str, floor: float):
    """M3: each trigger appends its alerts to ``table`` (key chunk_id); one that runs again changes nothing."""
    def store(batch: DataFrame, number: int) -> None:
        arrived = materialise(batch, "arrived")
        found = materialise(alerts(batch.sparkSession, path, arrived, floor), "alerts")
        append_version(found, table, "chunk_id", source=(checkpoint, number))
        drop_staged(arrived, found)

    return passages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
