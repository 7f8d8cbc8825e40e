"""Passage retrieval: ranking, scope, relevance floor, reload."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import collapse, words
from ..functions.defaults import RELEVANCE_FLOOR, SECTION_BOOST, TASK_SECTIONS, TASK_TOP_K
from .vector_search import nearest


def task_profiles(spark: SparkSession) -> DataFrame:
    """Boosted sections per task, a seven-row table."""
    rows = [(n, t, list(s)) for n, (t, s) in enumerate(TASK_SECTIONS.items())]
    return spark.createDataFrame(rows, "task_no int, task string, sections array<string>")


def task_plans(spark: SparkSession) -> DataFrame:
    """How many passages each task fetches."""
    return spark.createDataFrame(list(TASK_TOP_K.items()), "task string, task_k int")


def plan_retrieval(requests: DataFrame, plans: DataFrame) -> DataFrame:
    """Attach k to each request; a question may override it within 1..20."""
    asked = F.when(
        F.col("requested_k").isNotNull(), F.least(F.greatest(F.col("requested_k"), F.lit(1)), F.lit(20))
    )
    return requests.join(F.broadcast(plans), "task").withColumn(
        "top_k", F.when(F.col("task") == "qa", F.coalesce(asked, F.col("task_k"))).otherwise(F.col("task_k"))
    ).drop("task_k")


def retrieval_text(title: Column, abstract: Column) -> Column:
    """Title and abstract as one query text of at most 1,500 characters."""
    joined = F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))
    return F.when(joined == "", F.lit("summary of this paper")).otherwise(F.left(joined, F.lit(1500)))


def boosted_score(similarity: Column, section: Column, sections: Column, factor: float = SECTION_BOOST) -> Column:
    """Similarity raised when the passage's section is in the task's profile."""
    return similarity * F.when(F.array_contains(sections, section), factor).otherwise(F.lit(1.0))


def search(chunks: DataFrame, papers: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """Ranked passages per query within the query's own library.

    ``queries``: query_id, user_id, embedding, top_k, task, sections and optional
    want_* filters. Only passages of a paper that exists and belongs to the asking
    user are ranked: the papers decide before the best k are cut, so neither a
    passage marked with a wrong owner nor one without a paper comes back or takes
    a place. Text and titles are fetched for the ranked rows alone.
    """
    own = papers.select("paper_id", "user_id", "publication_year", F.col("title").alias("paper_title"))
    by_paper = {"want_project", "want_year", "want_tag"} & set(queries.columns)
    if by_paper:
        owned = papers.select("paper_id", "user_id", "project_id", "publication_year", "tags")
        pool = chunks.join(owned, ["paper_id", "user_id"] if "user_id" in chunks.columns else "paper_id")
    elif "user_id" in chunks.columns:
        pool = chunks.join(papers.select("paper_id", "user_id"), ["paper_id", "user_id"], "left_semi")
    else:
        pool = chunks.join(papers.select("paper_id", "user_id"), "paper_id")
    ranked = nearest(pool, queries.withColumnRenamed("query_id", "probe_id"), **options).withColumnRenamed(
        "probe_id", "query_id")
    return ranked.join(chunks.drop("embedding", "user_id"), "chunk_id").join(own, "paper_id")


def drop_near_identical(hits: DataFrame) -> DataFrame:
    """Keep the best hit of passages that open alike.

    Two lower-cased, space-collapsed texts cut to 220 characters count as equal
    when they are the same or share the first 120 of more than 80 characters;
    the first 120 characters are a key for exactly that relation. Runs over the
    top-k of a query, so a group holds at most k rows.
    """
    key = F.left(collapse(F.lower("content")), F.lit(120))
    first = Window.partitionBy("query_id", "_key").orderBy("rank")
    return (
        hits.withColumn("_key", key)
        .withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .drop("_key", "_n")
    )


def corpus_sizes(papers: DataFrame, scopes: DataFrame) -> DataFrame:
    """E5: completed papers in each scope (user, optional project, optional paper)."""
    done = papers.filter(F.col("processing_status") == "completed").select("user_id", "project_id", "paper_id")
    user, project, paper = F.col("user_id"), F.col("project_id"), F.col("paper_id")
    levels = done.groupingSets(
        [[user], [user, project], [user, paper], [user, project, paper]], user, project, paper
    ).agg(F.count_distinct("paper_id").alias("corpus_size"), F.grouping_id().alias("level"))
    asked = scopes.withColumn(
        "level",
        F.when(F.col("project_id").isNull(), 2).otherwise(0) + F.when(F.col("paper_id").isNull(), 1).otherwise(0),
    )
    a, b = asked.alias("a"), levels.alias("b")
    on = (
        (F.col("a.user_id") == F.col("b.user_id"))
        & (F.col("a.level") == F.col("b.level"))
        & F.col("a.project_id").eqNullSafe(F.col("b.project_id"))
        & F.col("a.paper_id").eqNullSafe(F.col("b.paper_id"))
    )
    return a.join(b, on, "left").select("a.*", F.coalesce("b.corpus_size", F.lit(0)).alias("corpus_size")).drop("level")


def evidence_strength(queries: DataFrame, hits: DataFrame, floor: float = RELEVANCE_FLOOR) -> DataFrame:
    """Best raw similarity per query and whether it clears the floor."""
    best = hits.groupBy("query_id").agg(
        F.max("similarity").alias("best_similarity"), F.count(F.lit(1)).alias("n_hits")
    )
    joined = queries.select("query_id").join(best, "query_id", "left")
    return joined.select(
        "query_id",
        "best_similarity",
        F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.coalesce(F.col("best_similarity") >= floor, F.lit(False)).alias("sufficient"),
    )


def evidence_gate(strength: DataFrame) -> DataFrame:
    """EMPTY / IRRELEVANT / OK.

    ``strength``: query_id, task, n_hits, sufficient and single_paper (a question
    about one chosen paper). Comparison, novelty and single-paper questions only
    need some evidence; for novelty external records count too.
    """
    external = F.coalesce(F.col("n_external"), F.lit(0)) if "n_external" in strength.columns else F.lit(0)
    found = F.col("n_hits") + F.when(F.col("task") == "novelty", external).otherwise(F.lit(0))
    exempt = F.col("task").isin("comparison", "novelty") | ((F.col("task") == "qa") & F.col("single_paper"))
    return strength.withColumn(
        "gate",
        F.when(found == 0, "EMPTY").when(~exempt & ~F.col("sufficient"), "IRRELEVANT").otherwise("OK"),
    )


def compared_papers_gate(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """E12 for comparisons: (query_id, missing_papers, gate).

    ``asked``: query_id, paper_id of every paper to compare. A comparison is
    refused when any of them has no passage among the hits.
    """
    found = hits.select("query_id", "paper_id").distinct().withColumn("found", F.lit(True))
    per_query = asked.select("query_id", "paper_id").distinct().join(found, ["query_id", "paper_id"], "left").groupBy(
        "query_id").agg(F.count_if(F.col("found").isNull()).alias("missing_papers"))
    return per_query.withColumn("gate", F.when(F.col("missing_papers") > 0, "EMPTY").otherwise("OK"))


def reload_chunks(requests: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Passages by id, owner-checked, in title then passage order.

    ``requests``: request_id, user_id, chunk_ids. A foreign or unknown id does
    not come back.
    """
    wanted = requests.select("request_id", F.col("user_id").alias("owner"), F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    own = papers.select("paper_id", F.col("user_id").alias("owner"), F.col("title").alias("paper_title"), "publication_year")
    found = wanted.join(chunks.drop("user_id"), "chunk_id").join(own, ["paper_id", "owner"])
    order = Window.partitionBy("request_id").orderBy(F.asc_nulls_last("paper_title"), "chunk_index", "chunk_id")
    return found.withColumn("position", F.row_number().over(order)).withColumnRenamed("owner", "user_id")


def encode_hashed(texts: DataFrame, text_col: str = "content", dim: int = 384) -> DataFrame:
    """E17 default encoder: hashed term counts as a unit vector, all inside the JVM."""
    tokens = texts.withColumn("_words", words(F.lower(F.col(text_col))))
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(tokens)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


def encode_with(
    texts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str = "content",
    batch: int = 64,
) -> DataFrame:
    """E17 with a caller's encoder: ``load`` runs once per task, texts go in batches of 64."""
    schema = texts.schema.simpleString()[len("struct<") : -1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for frame in frames:
            vectors: list[list[float]] = []
            for at in range(0, len(frame), batch):
                vectors.extend(encoder(frame[text_col].iloc[at : at + batch].tolist()))
            yield frame.assign(embedding=vectors)

    return texts.mapInPandas(run, f"{schema},embedding:array<float>")


def novelty_candidates(hits: DataFrame, works: DataFrame) -> DataFrame:
    """Library hits and external records of an idea as one evidence list."""
    library = hits.select(
        "query_id", F.lit("library").alias("origin"), F.col("chunk_id").cast("string").alias("evidence_id"),
        F.col("paper_title").alias("title"), "similarity",
    )
    external = works.select(
        "query_id", F.lit("external").alias("origin"), F.concat(F.lit("ext:"), "external_id").alias("evidence_id"),
        "title", F.lit(None).cast("double").alias("similarity"),
    )
    return library.unionByName(external)


