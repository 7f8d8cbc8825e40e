"""Group D: duplicates and near-identical passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import long
from ..operators import duplicates as D
from ..operators.metric_join import nearest_within
from ..operators.retrieval import drop_near_identical
from ..sources import tables as T
from .duck import sql
from .search import hits


def _d1(spark, folder):
    return D.exact_duplicates(T.read_papers(spark, folder)).select("paper_id", "user_id", "duplicate_of")


def _d2(spark, folder):
    p = T.read_papers(spark, folder).select("paper_id", "user_id", "title")
    found = D.similar_titles(p.withColumnRenamed("paper_id", "probe_id"), p)
    return found.select("probe_id", "similar_to", F.round("similarity", 4).alias("similarity"))


def _openings(spark, folder):
    return D.opening_duplicates(T.read_vector_chunks(spark, folder), T.read_papers(spark, folder).drop("text"), 0.25)


def _d3(spark, folder):
    return _openings(spark, folder).withColumn("similarity", F.round("similarity", 4))


def _d3_passages(spark, folder):
    """For every passage the closest one of another paper of its owner, cells split at 256 passages."""
    c = T.read_vector_chunks(spark, folder).select("chunk_id", "user_id", "paper_id", "embedding")
    probes = c.select(F.col("chunk_id").alias("probe_id"), "user_id", "embedding", F.col("paper_id").alias("skip_paper"))
    return nearest_within(c, probes, 0.45, cell_rows=256).withColumn("similarity", F.round("similarity", 4))


def _d4(spark, folder):
    papers = T.read_papers(spark, folder).select("paper_id", "user_id", "title")
    dup = D.exact_duplicates(T.read_papers(spark, folder)).select(
        "paper_id", "duplicate_of", F.lit(1.0).alias("similarity"))
    # Flags of every ninth document point at the next paper, which has another owner.
    flagged = D.attach_duplicates(papers, dup).withColumn(
        "duplicate_of", F.when(F.col("paper_id") % 9 == 0, F.col("paper_id") + 1).otherwise(F.col("duplicate_of")))
    return D.duplicate_warnings(flagged).select("paper_id", "warning_paper", "other_title",
                                                F.col("warning_similarity").cast("double").alias("warning_similarity"))


def _d5(spark, folder):
    return D.merge_catalogue(T.read_works(spark, folder)).select(
        "external_id", "title", long("cited_by_count").alias("cited_by_count"), "first_position")


def _d6(spark, folder):
    return drop_near_identical(hits(spark, folder)).select(
        "query_id", long("rank").alias("rank"), "chunk_id", F.round("score", 4).alias("score"))


_GRAMS = """
    SELECT paper_id, user_id, list_distinct(flatten(list_transform(
        regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'),
        lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g
    FROM papers"""

QUERIES = {
    "d1_exact_duplicates": (_d1, sql("""
        SELECT paper_id, user_id, first_id AS duplicate_of
        FROM (SELECT paper_id, user_id, first_value(paper_id) OVER (PARTITION BY user_id, content_hash ORDER BY created_at, paper_id) AS first_id FROM papers)
        WHERE paper_id <> first_id""")),
    "d2_title_trigrams": (_d2, sql("""
        SELECT probe_id, similar_to, round(sim, 4) AS similarity
        FROM (SELECT a.paper_id AS probe_id, b.paper_id AS similar_to,
                     len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS sim
              FROM grams a JOIN grams b ON a.user_id = b.user_id AND a.paper_id <> b.paper_id
              WHERE len(a.g) > 0 AND len(b.g) BETWEEN len(a.g) * 0.7 AND len(a.g) / 0.7)
        WHERE sim >= 0.72
        QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY sim DESC, similar_to) = 1""", grams=_GRAMS)),
    "d3_opening_duplicates": (_d3, sql("""
        SELECT a.paper_id, b.paper_id AS duplicate_of, round(max(list_cosine_similarity(a.embedding, b.embedding)), 4) AS similarity
        FROM vec_chunks a JOIN vec_chunks b ON a.user_id = b.user_id AND a.paper_id <> b.paper_id
        WHERE a.chunk_index = 0 AND b.chunk_index < 3
        GROUP BY a.paper_id, b.paper_id HAVING max(list_cosine_similarity(a.embedding, b.embedding)) >= 0.25
        QUALIFY row_number() OVER (PARTITION BY a.paper_id ORDER BY max(list_cosine_similarity(a.embedding, b.embedding)) DESC, b.paper_id) = 1""")),
    "d3_close_passages": (_d3_passages, sql("""
        SELECT a.chunk_id AS probe_id, b.chunk_id, round(list_cosine_similarity(a.embedding, b.embedding), 4) AS similarity
        FROM vec_chunks a JOIN vec_chunks b ON a.user_id = b.user_id AND a.paper_id <> b.paper_id
        WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.45
        QUALIFY row_number() OVER (PARTITION BY a.chunk_id ORDER BY list_cosine_similarity(a.embedding, b.embedding) DESC, b.chunk_id) = 1""")),
    "d4_duplicate_warning": (_d4, sql("""
        SELECT f.paper_id, o.paper_id AS warning_paper, o.title AS other_title,
               CASE WHEN o.paper_id IS NOT NULL AND f.own <> f.paper_id THEN 1.0::DOUBLE END AS warning_similarity
        FROM (SELECT paper_id, user_id, own, CASE WHEN paper_id % 9 = 0 THEN paper_id + 1 WHEN own <> paper_id THEN own END AS dup
              FROM (SELECT paper_id, user_id, first_value(paper_id) OVER (PARTITION BY user_id, content_hash ORDER BY created_at, paper_id) AS own FROM papers)) f
        LEFT JOIN papers o ON o.paper_id = f.dup AND o.user_id = f.user_id""")),
    "d5_catalogue_merge": (_d5, sql("""
        SELECT external_id, title, cited_by_count, min_pos AS first_position
        FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY coalesce(cited_by_count, 0) DESC, position) AS rn,
                     min(position) OVER (PARTITION BY k) AS min_pos
              FROM (SELECT *, CASE WHEN regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g') = '' THEN 'id:' || external_id
                              ELSE regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g') END AS k FROM works))
        WHERE rn = 1""")),
    "d6_hit_dedupe": (_d6, sql("""
        SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM hits
        QUALIFY row_number() OVER (PARTITION BY query_id, left(trim(regexp_replace(lower(content), '\\s+', ' ', 'g')), 120) ORDER BY rank) = 1""")),
}
