"""Group M and the composed plans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import long
from ..operators import fusion as U
from ..operators import keyword as K
from ..plans.answering import check_replies, prepare_comparisons, prepare_requests
from ..session import shared_folder
from ..sources import tables as T
from ..sources.versions import read_versions
from ..streaming import jobs as J
from ..streaming import percolate as P
from .duck import VIEWS, sql
from .search import KEYWORD, _stems, hits, marked_chunks, questions, raw_hits
from .streams import _stream


def _keyword(spark, folder):
    """The first two words of every benchmark passage as keyword query of each user over the same passages."""
    content = T.read_vector_content(spark, folder)
    chunks = T.read_vector_chunks(spark, folder).join(content, "chunk_id").select("chunk_id", "user_id", "content")
    words = F.slice(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), 1, 2)
    items = T.scan(spark, folder, "benchmark").select("item_id", F.array_join(words, " ").alias("text"))
    qs = _item_questions(spark, folder).select("query_id", "user_id", "item_id").join(items, "item_id")
    return K.keyword_search(chunks, qs.drop("item_id"))


def _item_questions(spark, folder):
    """Every benchmark passage asked of every user, with the vector of one of the user's questions."""
    items = T.scan(spark, folder, "benchmark").select("item_id", (F.col("item_id") % 10).alias("label"))
    qs = questions(spark, folder).withColumn("label", F.col("query_id") % 100)
    return qs.join(items, "label").withColumn("query_id", F.col("item_id") * 10 + F.col("user_id")).drop("label")


def _m1(spark, folder):
    f = U.fuse_rankings(raw_hits(spark, folder, _item_questions(spark, folder)), _keyword(spark, folder))
    return f.select("query_id", "chunk_id", long("rank").alias("rank"), long("vector_rank").alias("vector_rank"),
                    long("keyword_rank").alias("keyword_rank"), F.round("fused", 6).alias("fused"))


def _m2(spark, folder):
    qs = questions(spark, folder)
    label = F.array_position(F.array(*[F.lit(s) for s in T.SECTION_LABELS]), F.col("section_type")) - 1
    relevant = T.read_vector_chunks(spark, folder).select((F.col("user_id") * 100 + label).alias("query_id"), "chunk_id")
    return U.recall_at(raw_hits(spark, folder, qs), relevant, 8).withColumn("recall", F.round("recall", 4))


def _m3(spark, folder):
    new = _stream(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), (F.floor(F.col("vec_id") / 5) % 8).cast("bigint").alias("user_id"), "embedding")
    alerts = J.saved_search_alerts(new, questions(spark, folder), 0.45)
    return spark.read.parquet(J.run_available(alerts, "alerts")).select("query_id", "chunk_id", F.round("similarity", 4).alias("similarity"))


def _m3_percolation(spark, folder):
    """Questions and benchmark passages as saved queries, by vector and by their first two words, met by all passages as a stream."""
    qs = _item_questions(spark, folder)
    words = F.slice(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), 1, 2)
    items = T.scan(spark, folder, "benchmark").select("item_id", F.array_join(words, " ").alias("text"))
    base = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    P.store_saved(qs.join(items, "item_id").select("query_id", "user_id", "embedding", "text"), base, cell_rows=64)
    chunk = F.col("vec_id")
    new = _stream(spark, folder, "embeddings").select(
        chunk.alias("chunk_id"), (F.floor(chunk / 5) % 8).cast("bigint").alias("user_id"), "embedding").join(
        T.read_vector_content(spark, folder), "chunk_id")
    P.alert_stream(new, base, f"{base}/alerts", f"{base}/state", 0.45).awaitTermination()
    return read_versions(spark, f"{base}/alerts", "chunk_id").withColumn("similarity", F.round("similarity", 4))


def _m4(spark, folder):
    g = U.library_growth(T.read_library(spark, folder))
    return g.select("user_id", F.date_format("period", "yyyy-MM").alias("period"), "added", "total")


def _m5(spark, folder):
    return U.tier_mix(T.read_analyses(spark, folder))


def _requests(spark, folder):
    content = T.read_vector_content(spark, folder)
    chunks = marked_chunks(spark, folder).join(content, "chunk_id", "left").withColumn(
        "content", F.coalesce("content", F.concat(F.lit("passage "), "chunk_id")))
    qs = questions(spark, folder).withColumns({
        "text": F.concat(F.lit("Question "), "query_id"), "single_paper": F.lit(False), "refresh": F.col("query_id") % 7 == 0})
    stored = T.read_analyses(spark, folder).select("analysis_id", "user_id", "cache_key")
    r = prepare_requests(qs, chunks, T.read_papers(spark, folder).drop("text"), stored, budget=100_000, floor=0.5)
    return r.select("query_id", "task", "gate", "cache_plan", "calls_model", long(F.size("evidence_ids")).alias("n_evidence"),
                    F.col("context").isNotNull().alias("has_context"))


def _compared(spark, folder):
    """Every four papers are compared."""
    papers = T.read_papers(spark, folder).select("paper_id", "title")
    return papers.select(F.floor(F.col("paper_id") / 4).alias("request_id"), "paper_id", "title")


def _comparison(spark, folder):
    asked = _compared(spark, folder)
    own = F.col("paper_id")
    hits = T.read_text_chunks(spark, folder).select(
        F.floor(own / 4).alias("query_id"), "chunk_id", "paper_id", F.lit("T").alias("paper_title"), "section_type",
        "chunk_index", "content", (-F.col("chunk_index")).cast("double").alias("score"))
    contexts = prepare_comparisons(asked.withColumnRenamed("request_id", "query_id"), hits, 18_000)
    sizes = contexts.groupBy(F.col("query_id").alias("request_id"), "gate").agg(
        long(F.count("context")).alias("n_contexts"))
    replies = asked.select("request_id").distinct().withColumn("text", F.concat(
        F.lit('{"papers":[],"dimensions":[{"name":"method","values":["v'), "request_id", F.lit('"," "]}]}')))
    checked = check_replies(replies, hits.withColumnRenamed("query_id", "request_id"), "comparison", asked=asked)
    cells = checked.select("request_id", F.array_join("papers.paper_id", ",").alias("papers"),
                           F.array_join(F.col("dimensions")[0]["values"], "|").alias("cells"))
    return sizes.join(cells, "request_id")


def _review(spark, folder):
    asked = _compared(spark, folder)
    evidence = T.read_text_chunks(spark, folder).join(asked.drop("title"), "paper_id").select(
        "request_id", "chunk_id", "paper_id", F.concat(F.lit("T"), "paper_id").alias("paper_title"), "content")
    r = F.col("request_id")
    refs = F.when(r % 3 == 0, F.concat(F.lit('{"paper_id":"'), r * 4, F.lit('","title":"own"},{"paper_id":"999999999","title":"foreign"}'))
                  ).when(r % 3 == 1, F.lit('{"paper_id":"999999999","title":"foreign"}')).otherwise(F.lit(""))
    replies = evidence.select("request_id").distinct().select(
        "request_id", (r % 40).cast("int").alias("corpus_size"),
        F.concat(F.lit('{"overview":"o","references":['), refs, F.lit('],"confidence":"high"}')).alias("text"))
    out = check_replies(replies, evidence, "literature_review")
    return out.select("request_id", "confidence", F.array_join(
        F.transform("references", lambda x: F.concat_ws(":", x["paper_id"], x["title"])), ",").alias("refs"))


_M1 = {
    **KEYWORD,
    "toks": f"""SELECT vec_id AS doc_id, (vec_id // 5) % 8 AS user_id, source, text, {_stems('text')} AS all_terms
               FROM embeddings JOIN documents ON doc_id = vec_id""",
    "asks": f"""
        SELECT query_id, user_id, terms, NULL AS want_project FROM (SELECT q.query_id, q.user_id,
            list_sort(list_distinct({_stems("array_to_string(regexp_extract_all(b.text, '\\p{L}+')[1:2], ' ')")})) AS terms
        FROM questions q JOIN benchmark b ON b.item_id = q.query_id // 10) WHERE len(terms) > 0""",
    "asked_of_all": VIEWS["questions"],
    "questions": """
        SELECT item_id * 10 + user_id AS query_id, user_id, task, sections, embedding
        FROM asked_of_all q JOIN benchmark ON item_id % 10 = q.query_id % 100""",
}

QUERIES = {
    "m1_hybrid_fusion": (_m1, sql("""
        SELECT query_id, chunk_id, rank, vector_rank, keyword_rank, round(fused, 6) AS fused FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM (
            SELECT coalesce(h.query_id, k.query_id) AS query_id, coalesce(h.chunk_id, k.chunk_id) AS chunk_id, h.rank AS vector_rank, k.rank AS keyword_rank,
                   round(coalesce(1 / (60.0::DOUBLE + h.rank), 0) + coalesce(1 / (60.0::DOUBLE + k.rank), 0), 9) AS fused
            FROM hits h FULL JOIN kw k ON k.query_id = h.query_id AND k.chunk_id = h.chunk_id)) WHERE rank <= 20""", **_M1)),
    "m2_recall_at_k": (_m2, sql("""
        SELECT c.user_id * 100 + c.label AS query_id, count(*) AS relevant, count(h.chunk_id) AS found, round(count(h.chunk_id) / count(*), 4) AS recall
        FROM vec_chunks c LEFT JOIN hits h ON h.query_id = c.user_id * 100 + c.label AND h.chunk_id = c.chunk_id GROUP BY 1""")),
    "m3_saved_search_alerts": (_m3, sql("""
        SELECT query_id, chunk_id, round(list_cosine_similarity(c.embedding, q.embedding), 4) AS similarity
        FROM vec_chunks c JOIN questions q ON c.user_id = q.user_id
        WHERE list_cosine_similarity(c.embedding, q.embedding) >= 0.45""")),
    "m3_percolation": (_m3_percolation, sql("""
        WITH near AS (SELECT query_id, chunk_id, round(list_cosine_similarity(c.embedding, q.embedding), 4) AS similarity
                      FROM vec_chunks c JOIN documents d ON d.doc_id = c.chunk_id JOIN questions q ON c.user_id = q.user_id
                      WHERE list_cosine_similarity(c.embedding, q.embedding) >= 0.45),
             worded AS (SELECT query_id, doc_id AS chunk_id FROM asks a JOIN toks d ON a.user_id = d.user_id AND list_has_all(d.all_terms, a.terms))
        SELECT coalesce(n.query_id, w.query_id) AS query_id, coalesce(n.chunk_id, w.chunk_id) AS chunk_id, similarity, w.query_id IS NOT NULL AS by_words
        FROM near n FULL JOIN worded w ON w.query_id = n.query_id AND w.chunk_id = n.chunk_id""", **_M1)),
    "m4_library_growth": (_m4, sql("""
        SELECT user_id, period, added, (sum(added) OVER (PARTITION BY user_id ORDER BY period))::BIGINT AS total
        FROM (SELECT user_id, strftime(created_at, '%Y-%m') AS period, count(*) AS added FROM library GROUP BY ALL)""")),
    "m5_tier_mix": (_m5, sql("""
        SELECT CASE WHEN analysis_type = 'concepts' THEN 'fast' ELSE 'strong' END AS tier, provider, model_id, count(*) AS analyses FROM analyses GROUP BY ALL""")),
    "plan_comparison": (_comparison, sql("""
        WITH asked AS (SELECT paper_id // 4 AS request_id, paper_id FROM papers),
             have AS (SELECT DISTINCT paper_id FROM text_chunks),
             g AS (SELECT request_id, count(*) AS n, count(h.paper_id) AS found, array_to_string(list(a.paper_id::VARCHAR ORDER BY a.paper_id::VARCHAR), ',') AS papers
                   FROM asked a LEFT JOIN have h ON h.paper_id = a.paper_id GROUP BY request_id)
        SELECT request_id, CASE WHEN found < n THEN 'EMPTY' ELSE 'OK' END AS gate, CASE WHEN found < n THEN 0 ELSE n END AS n_contexts, papers,
               'v' || request_id || repeat('|Not reported', n::INTEGER - 1) AS cells FROM g""")),
    "plan_review": (_review, sql("""
        WITH gave AS (SELECT DISTINCT paper_id // 4 AS request_id, paper_id FROM text_chunks),
             own AS (SELECT request_id, bool_or(paper_id = request_id * 4) AS has_own, array_to_string(list(paper_id::VARCHAR || ':T' || paper_id ORDER BY paper_id::VARCHAR), ',') AS everyone FROM gave GROUP BY request_id)
        SELECT request_id, CASE WHEN request_id % 40 < 5 THEN 'low' WHEN request_id % 40 < 15 THEN 'medium' ELSE 'high' END AS confidence,
               CASE WHEN request_id % 3 = 0 AND has_own THEN (request_id * 4) || ':own' ELSE everyone END AS refs FROM own""")),
    "plan_model_requests": (_requests, sql("""
        WITH kept AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, left(trim(regexp_replace(lower(content), '\\s+', ' ', 'g')), 120) ORDER BY rank) = 1),
             g AS (SELECT q.query_id, q.task, count(k.chunk_id) AS n, CASE WHEN count(k.chunk_id) = 0 THEN 'EMPTY' WHEN q.task IN ('comparison', 'novelty') OR max(similarity) >= 0.5 THEN 'OK' ELSE 'IRRELEVANT' END AS gate
                   FROM questions q LEFT JOIN kept k ON k.query_id = q.query_id GROUP BY q.query_id, q.task)
        SELECT query_id, task, gate, CASE WHEN gate = 'OK' THEN CASE WHEN query_id % 7 = 0 THEN 'refresh' ELSE 'miss' END END AS cache_plan,
               CASE WHEN gate = 'OK' THEN true END AS calls_model, n AS n_evidence, gate = 'OK' AS has_context FROM g""")),
}
