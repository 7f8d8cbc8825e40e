"""Group I: cache, jobs, re-index, isolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import long
from ..operators import bookkeeping as B
from ..operators import maintenance as M
from ..sources import tables as T
from .duck import sql
from .tables import _stored


def _i1(spark, folder):
    a, k = T.read_analyses(spark, folder), F.col("analysis_id")
    evidence = F.when(k % 5 != 0, F.array(
        F.concat(F.lit("c"), k % 17), F.concat(F.lit("c"), k % 5), F.concat(F.lit("ext:W"), k % 3)))
    query = F.when(k % 7 != 0, F.concat(F.lit("  What\t ABOUT  "), "input_query", F.lit(" ")))
    model = F.when(k % 4 != 0, F.col("model_id"))
    return a.select("analysis_id", B.cache_key(F.col("analysis_type"), model, query, F.coalesce(evidence, F.array().cast("array<string>"))).alias("cache_key"))


def _i2(spark, folder):
    stored, fresh = _stored(spark, folder)
    once = M.first_per_key(stored, ["user_id", "cache_key"], ["created_at", "analysis_id"])
    req = fresh.select(F.col("analysis_id").alias("request_id"), "user_id", "cache_key", (F.col("analysis_id") % 11 == 0).alias("refresh"))
    return B.plan_cache(req, once).select("request_id", "cache_plan", "stored_id", "calls_model")


def _i3(spark, folder):
    o = T.scan(spark, folder, "lineitem", ["l_orderkey", "l_partkey"]).groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("ids"))
    return o.select("l_orderkey", B.comparison_key(F.col("ids")).alias("comparison_key"))


def _i4(spark, folder):
    out = B.job_status(T.read_papers(spark, folder), T.read_jobs(spark, folder))
    return out.withColumns({"progress": long("progress"), "attempts": long("attempts")})


def _i5(spark, folder):
    return B.recovery_plan(T.read_jobs(spark, folder)).select("job_id", "paper_id", "action", "error_message")


def _i6(spark, folder):
    f = T.read_jobs(spark, folder).filter("status = 'failed'").select("job_id", "error_code", "http_status", "attempts")
    return B.classify_failures(f).select("job_id", "transient", "retry_now", "worth_retrying", "error_text")


def _i7(spark, folder):
    f = T.read_jobs(spark, folder).filter("status = 'failed'")
    return B.retry_schedule(f).select("job_id", long("attempt").alias("attempt"), "wait_ms")


def _plan(spark, folder):
    return B.reindex_plan(T.read_papers(spark, folder).drop("text"), T.read_jobs(spark, folder), limit=15)


def _i8(spark, folder):
    return _plan(spark, folder)[1]


def _i8b(spark, folder):
    return _plan(spark, folder)[0].select("user_id", "paper_id", long("rank").alias("rank"))


def _i9(spark, folder):
    return B.step_progress(T.read_jobs(spark, folder).select("job_id", "current_step")).select("job_id", "current_step", long("step_progress").alias("step_progress"))


def _i10(spark, folder):
    return B.cross_owner_rows(T.read_analyses(spark, folder), T.read_papers(spark, folder), "paper_id").select("analysis_id", "user_id", "parent_owner")


def _i11(spark, folder):
    counts, stale = B.model_drift(T.read_vector_chunks(spark, folder), "encoder-v1")
    return counts.select(F.concat(F.lit("model "), "embedding_model").alias("item"), "chunks").unionByName(
        stale.select(F.concat(F.lit("paper "), "paper_id").alias("item"), F.col("stale_chunks").alias("chunks")))


_CODES = "(VALUES " + ", ".join(f"('{c}', {str(r).lower()}, '{m}')" for c, r, m in B.FAILURE_CODES) + ") t(code, ok, msg)"
_STEPS = "(VALUES " + ", ".join(f"('{s}', {p})" for s, p in B.STEP_PROGRESS) + ") t(step, p)"
_REINDEX = {
    "outd": "SELECT paper_id, user_id, created_at FROM papers WHERE index_version < 1 AND processing_status = 'completed' AND object_key IS NOT NULL",
    "act": "SELECT DISTINCT paper_id FROM jobs WHERE status IN ('queued', 'running')",
    "walk": """SELECT *, sum((NOT busy)::INT) OVER (PARTITION BY user_id ORDER BY created_at, paper_id) AS done
               FROM (SELECT *, paper_id IN (SELECT paper_id FROM act) AS busy FROM outd)""",
}

QUERIES = {
    "i1_cache_key": (_i1, sql("""
        SELECT analysis_id, sha256(analysis_type || '|' || CASE WHEN analysis_id % 4 <> 0 THEN model_id ELSE '' END || '|'
          || CASE WHEN analysis_id % 7 <> 0 THEN 'what about ' || lower(input_query) ELSE '' END || '|'
          || CASE WHEN analysis_id % 5 <> 0 THEN ',' || array_to_string(list_sort(['c' || analysis_id % 17, 'c' || analysis_id % 5, 'ext:W' || analysis_id % 3]), ',') ELSE '' END) AS cache_key
        FROM analyses""")),
    "i2_cache_plan": (_i2, sql("""
        WITH stored AS (SELECT user_id, cache_key, min_by(analysis_id, (created_at, analysis_id)) AS stored_id FROM analyses WHERE created_at < TIMESTAMP '2024-01-16' GROUP BY ALL),
             req AS (SELECT a.analysis_id AS request_id, a.user_id, a.cache_key, stored_id,
                            CASE WHEN a.analysis_id % 11 = 0 THEN 'refresh' WHEN stored_id IS NOT NULL THEN 'hit' ELSE 'miss' END AS cache_plan
                     FROM analyses a LEFT JOIN stored s ON s.user_id = a.user_id AND s.cache_key = a.cache_key WHERE created_at >= TIMESTAMP '2024-01-16')
        SELECT request_id, cache_plan, stored_id,
               CASE cache_plan WHEN 'hit' THEN false WHEN 'refresh' THEN true
                    ELSE request_id = min(request_id) FILTER (WHERE cache_plan = 'miss') OVER (PARTITION BY user_id, cache_key) END AS calls_model FROM req""")),
    "i3_comparison_key": (_i3, """
        SELECT l_orderkey, CASE WHEN count(DISTINCT l_partkey) >= 2 THEN '|' || array_to_string(list_sort(list(DISTINCT l_partkey::VARCHAR)), '|') END AS comparison_key
        FROM lineitem GROUP BY l_orderkey"""),
    "i4_job_status": (_i4, sql("""
        SELECT p.paper_id, j.job_id, coalesce(j.status, p.processing_status) AS status, j.current_step,
               coalesce(j.progress, CASE WHEN p.processing_status = 'completed' THEN 100 ELSE 0 END) AS progress, coalesce(j.attempts, 0) AS attempts,
               CASE WHEN j.job_id IS NOT NULL THEN j.status = 'failed' AND j.retryable ELSE p.processing_status = 'failed' END AS retryable
        FROM papers p LEFT JOIN (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY created_at DESC, job_id DESC) = 1) j ON j.paper_id = p.paper_id""")),
    "i5_recovery_plan": (_i5, sql(f"""
        SELECT job_id, paper_id, CASE WHEN attempts >= 3 THEN 'fail' ELSE 'resume' END AS action,
               CASE WHEN attempts >= 3 THEN '{B.STRANDED_MESSAGE}' END AS error_message FROM jobs WHERE status IN ('queued', 'running')""")),
    "i6_failure_class": (_i6, sql(f"""
        SELECT job_id, http_status >= 500 OR http_status = 429 AS transient, (http_status >= 500 OR http_status = 429) AND attempts < 3 AS retry_now,
               coalesce(ok, true) AS worth_retrying, coalesce(msg, '{B.DEFAULT_MESSAGE}') AS error_text
        FROM jobs LEFT JOIN {_CODES} ON code = error_code WHERE status = 'failed'""")),
    "i7_retry_schedule": (_i7, sql("""
        SELECT job_id, attempt, CASE attempt WHEN 1 THEN 0 WHEN 2 THEN 2000 ELSE 4000 END::BIGINT AS wait_ms
        FROM jobs, range(1, 4) r(attempt) WHERE status = 'failed' AND attempt > attempts""")),
    "i8_reindex_report": (_i8, sql("""
        SELECT user_id, count(*) AS outdated, least(max(done), 15)::BIGINT AS queued,
               count(*) FILTER (WHERE busy AND done < 15) AS busy, (count(*) - least(max(done), 15))::BIGINT AS remaining FROM walk GROUP BY user_id""", **_REINDEX)),
    "i8_reindex_queue": (_i8b, sql("SELECT user_id, paper_id, done::BIGINT AS rank FROM walk WHERE NOT busy AND done <= 15", **_REINDEX)),
    "i9_step_progress": (_i9, sql(f"SELECT job_id, current_step, p::BIGINT AS step_progress FROM jobs LEFT JOIN {_STEPS} ON step = current_step")),
    "i10_owner_isolation": (_i10, sql("SELECT analysis_id, a.user_id, p.user_id AS parent_owner FROM analyses a JOIN papers p ON p.paper_id = a.paper_id WHERE a.user_id <> p.user_id")),
    "i11_model_drift": (_i11, sql("""
        SELECT 'model ' || embedding_model AS item, count(*) AS chunks FROM vec_chunks GROUP BY 1
        UNION ALL SELECT 'paper ' || paper_id, count(*) FROM vec_chunks WHERE embedding_model <> 'encoder-v1' GROUP BY 1""")),
}
