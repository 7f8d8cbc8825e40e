"""Table scans (A1) and the library model read from the supplied star schema.

The ``read_*`` functions give the operators' input shapes from the supplied
parquet tables: papers and passages from ``documents`` and ``embeddings``, a
library from ``orders``, concepts from ``lineitem`` and ``part``, activity from
``events``. Derived attributes are arithmetic on real columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import long
from ..functions.defaults import SECTION_LABELS
from ..session import stored_bytes

EPOCH = 1_704_067_200  # 2024-01-01


def scan(spark: SparkSession, folder: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """A1: columnar scan; filters and column choice reach the parquet reader."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return df.select(*columns) if columns else df


# Tables of at most so many bytes are dealt over all cores before costly work on their rows.
SMALL_BYTES = 64 << 20


def read_documents(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Documents for work on their texts.

    A small file is one task however many cores there are, so a table whose files
    are measured to be small is dealt out; a larger one is read in its splits.
    """
    rows = scan(spark, folder, "documents", columns)
    if stored_bytes(spark, f"{folder}/documents.parquet") > SMALL_BYTES:
        return rows
    return rows.repartition(spark.sparkContext.defaultParallelism, "doc_id")


def pick(values, index: Column) -> Column:
    """Element ``index`` (from 0) of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def read_papers(spark: SparkSession, folder: str, *, for_text: bool = False) -> DataFrame:
    """Papers; ``for_text`` where costly work on the texts follows."""
    doc = F.col("doc_id")
    read = read_documents if for_text else lambda s, f, c: scan(s, f, "documents", c)
    status = (
        F.when(doc % 10 == 0, "failed")
        .when(doc % 10 == 1, "queued")
        .when(doc % 10 == 2, "metadata_only")
        .otherwise("completed")
    )
    return read(spark, folder, ["doc_id", "text", "lang", "source", "n_chars"]).select(
        doc.alias("paper_id"),
        (doc % 8).alias("user_id"),
        F.col("source").alias("project_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.array(
            F.concat(pick(("Ada", "Bo", "Cy", "Di", "Eve"), doc % 5), F.lit(" "), F.initcap("source")),
            F.concat(F.initcap("lang"), F.lit(" Writer")),
        ).alias("authors"),
        F.array("lang", "source").alias("tags"),
        F.when(doc % 11 != 0, 1990 + doc % 35).cast("int").alias("publication_year"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("n_chars").alias("file_size"),
        F.when(doc % 10 != 2, F.concat(F.lit("papers/"), doc % 8, F.lit("/"), doc, F.lit("/original.pdf"))).alias(
            "object_key"
        ),
        status.alias("processing_status"),
        pick(("to_read", "reading", "read"), doc % 3).alias("reading_status"),
        (doc % 2).cast("int").alias("index_version"),
        F.timestamp_seconds(F.lit(EPOCH) + doc * 60).alias("created_at"),
        F.timestamp_seconds(F.lit(EPOCH) + ((doc * 7919) % 100_000) * 60).alias("updated_at"),
        F.col("text"),
    )


def read_text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Non-blank document lines as passages."""
    lines = read_documents(spark, folder, ["doc_id", "text"]).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content")
    )
    return lines.filter(F.trim("content") != "").select(
        F.concat_ws(":", "doc_id", "pos").alias("chunk_id"),
        F.col("doc_id").alias("paper_id"),
        (F.col("doc_id") % 8).alias("user_id"),
        F.col("pos").alias("chunk_index"),
        pick(SECTION_LABELS, (F.col("doc_id") + F.col("pos")) % 10).alias("section_type"),
        F.col("content"),
    )


def read_vector_chunks(spark: SparkSession, folder: str) -> DataFrame:
    vec = F.col("vec_id")
    paper = F.expr("vec_id div 5")
    return scan(spark, folder, "embeddings").select(
        vec.alias("chunk_id"),
        paper.alias("paper_id"),
        (paper % 8).alias("user_id"),
        (vec % 5).cast("int").alias("chunk_index"),
        pick(SECTION_LABELS, F.col("label")).alias("section_type"),
        F.col("embedding"),
        F.when(vec % 7 == 0, "encoder-v0").otherwise("encoder-v1").alias("embedding_model"),
    )


def read_vector_content(spark: SparkSession, folder: str) -> DataFrame:
    """Passage text of each vector: the document of the same number."""
    return scan(spark, folder, "documents", ["doc_id", "text"]).select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")
    )


def read_library(spark: SparkSession, folder: str) -> DataFrame:
    return scan(
        spark, folder, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    ).select(
        F.col("o_orderkey").alias("paper_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("project_id"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "queued")
        .otherwise("failed")
        .alias("processing_status"),
        F.when(F.col("o_orderkey") % 13 != 0, F.year("o_orderdate")).alias("publication_year"),
        F.col("o_orderdate").alias("created_at"),
    )


def read_concepts(spark: SparkSession, folder: str) -> DataFrame:
    lines = scan(spark, folder, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_discount"])
    parts = scan(spark, folder, "part", ["p_partkey", "p_name", "p_size"])
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("paper_id"),
        F.col("p_name").alias("concept"),
        pick(("keyword", "method", "dataset", "metric", "domain"), F.col("p_size") % 5).alias("concept_type"),
        (F.col("l_discount") * 10).alias("confidence"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
    )


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        long(F.get_json_object("props", "$.k")).alias("k"),
    )


def read_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Indexing jobs: one per event, several per paper."""
    ev = read_events(spark, folder)
    kind = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("job_id"),
        (F.col("user_id") * 5 + F.col("k") % 5).alias("paper_id"),
        F.when(kind == "signup", "queued")
        .when(kind == "click", "running")
        .when(kind == "error", "failed")
        .otherwise("completed")
        .alias("status"),
        pick(("Queued", "Preparing", "Chunking", "Storing index"), F.col("k") % 4).alias("current_step"),
        (F.col("k") % 101).cast("int").alias("progress"),
        (F.col("k") % 4).cast("int").alias("attempts"),
        (F.col("k") % 3 != 0).alias("retryable"),
        pick(
            ("PDF_UNREADABLE", "PDF_ENCRYPTED", "NO_EXTRACTABLE_TEXT", "PDF_TOO_COMPLEX",
             "FILE_NOT_FOUND", "AI_UNAVAILABLE", "RATE_LIMITED", "UNKNOWN"),
            F.col("k") % 8,
        ).alias("error_code"),
        pick((422, 429, 500, 503, 404), F.col("k") % 5).alias("http_status"),
        F.col("ts").alias("created_at"),
    )


def read_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """Stored analyses: one per event."""
    ev = read_events(spark, folder)
    return ev.select(
        F.col("event_id").alias("analysis_id"),
        F.col("user_id"),
        F.concat(F.lit("p"), F.col("k") % 6).alias("project_id"),
        (F.col("user_id") * 5 + F.col("k") % 5).alias("paper_id"),
        pick(("summary", "qa", "comparison", "research_gap", "novelty", "literature_review", "concepts"),
             F.col("k") % 7).alias("analysis_type"),
        F.concat_ws(" ", F.lit("What about"), "event_type", F.col("k")).alias("input_query"),
        pick(("fast-model", "strong-model"), F.col("k") % 2).alias("model_id"),
        pick(("groq", "gemini"), F.col("k") % 2).alias("provider"),
        F.sha2(F.concat_ws("|", "event_type", F.col("k")), 256).alias("cache_key"),
        F.col("ts").alias("created_at"),
    )


def read_works(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue records; documents hold exact and near copies."""
    doc = F.col("doc_id")
    return scan(spark, folder, "documents", ["doc_id", "text", "lang", "source"]).select(
        F.concat(F.lit("W"), doc).alias("external_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(doc % 9 != 0, (doc * 37) % 1000).alias("cited_by_count"),
        doc.alias("position"),
        F.col("lang"),
        F.col("source"),
    )
