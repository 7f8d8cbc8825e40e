"""Cache keys and plans, jobs, re-index planning, isolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import collapse
from ..functions.defaults import INDEX_VERSION, MAX_ATTEMPTS, RETRY_BASE_MS

# Failure codes, whether another attempt may help, and the message.
FAILURE_CODES = (
    ("PDF_UNREADABLE", False, "We could not read this PDF. The file may be damaged."),
    ("PDF_ENCRYPTED", False, "This PDF is password protected. Remove the password and upload it again."),
    ("NO_EXTRACTABLE_TEXT", False, "This looks like a scanned PDF. Text extraction is not supported yet."),
    ("PDF_TOO_COMPLEX", False, "This PDF is too large or too complex to index safely."),
    ("STORAGE_READ_FAILED", True, "We could not read the stored file for this paper. Try re-uploading it."),
    ("FILE_NOT_FOUND", True, "We could not read the stored file for this paper. Try re-uploading it."),
    ("AI_UNAVAILABLE", True, "Indexing is temporarily unavailable. Retry in a few minutes."),
)
DEFAULT_MESSAGE = "Indexing failed. You can retry it."
STRANDED_MESSAGE = "Indexing did not finish after several attempts. You can retry it."

# Progress shown at each indexing step.
STEP_PROGRESS = (
    ("Queued", 0), ("Preparing", 5), ("Downloading file", 10), ("Extracting text", 25), ("Detecting sections", 40),
    ("Chunking", 55), ("Generating embeddings", 70), ("Storing index", 90), ("Complete", 100),
)


def cache_key(kind: Column, model: Column, query: Column, evidence: Column) -> Column:
    """Fingerprint of task, model, normalised question and sorted evidence."""
    keys = F.array_join(F.transform(F.array_sort(evidence), lambda k: F.concat(F.lit(","), k)), "")
    question = F.lower(collapse(F.coalesce(query, F.lit(""))))
    return F.sha2(
        F.concat(kind, F.lit("|"), F.coalesce(model, F.lit("")), F.lit("|"), question, F.lit("|"), F.coalesce(keys, F.lit(""))), 256
    )


def plan_cache(requests: DataFrame, stored: DataFrame, *, enabled: bool = True) -> DataFrame:
    """Hit, miss, refresh or disabled for each request; one call per missing key.

    ``requests``: request_id, user_id, cache_key, refresh.
    """
    known = stored.select("user_id", "cache_key", F.col("analysis_id").alias("stored_id"))
    joined = requests.join(known, ["user_id", "cache_key"], "left")
    found = F.col("stored_id").isNotNull()
    plan = (
        F.when(F.lit(not enabled), "off")
        .when(F.col("refresh"), "refresh")
        .when(found, "hit")
        .otherwise("miss")
    )
    planned = joined.withColumn("cache_plan", plan)
    lead = planned.filter("cache_plan = 'miss'").groupBy("user_id", "cache_key").agg(F.min("request_id").alias("lead_id"))
    return planned.join(lead, ["user_id", "cache_key"], "left").withColumn(
        "calls_model", F.when(F.col("cache_plan") == "miss", F.col("request_id") == F.col("lead_id")).otherwise(F.col("cache_plan") != "hit")
    ).drop("lead_id")


def comparison_key(paper_ids: Column) -> Column:
    """Sorted distinct papers, each led by a bar; null for fewer than two papers."""
    ids = F.array_sort(F.array_distinct(F.transform(paper_ids, lambda p: p.cast("string"))))
    joined = F.array_join(F.transform(ids, lambda p: F.concat(F.lit("|"), p)), "")
    return F.when(F.size(ids) >= 2, joined)


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The newest job of each paper, combined map-side."""
    rest = [c for c in jobs.columns if c != "paper_id"]
    newest = jobs.groupBy("paper_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "job_id")).alias("j"))
    return newest.select("paper_id", *[F.col(f"j.{c}").alias(c) for c in rest])


def job_status(papers: DataFrame, jobs: DataFrame) -> DataFrame:
    """I4: status of each paper's newest job, or one made from the paper itself."""
    j = latest_jobs(jobs).select(
        "paper_id", "job_id", F.col("status").alias("job_status"), "current_step", F.col("progress").alias("job_progress"),
        F.col("attempts").alias("job_attempts"), F.col("retryable").alias("job_retryable"),
    )
    joined = papers.select("paper_id", "processing_status").join(j, "paper_id", "left")
    has_job = F.col("job_id").isNotNull()
    return joined.select(
        "paper_id",
        "job_id",
        F.coalesce("job_status", "processing_status").alias("status"),
        "current_step",
        F.when(has_job, F.col("job_progress")).when(F.col("processing_status") == "completed", 100).otherwise(0).alias("progress"),
        F.coalesce("job_attempts", F.lit(0)).alias("attempts"),
        F.when(has_job, (F.col("job_status") == "failed") & F.col("job_retryable"))
        .otherwise(F.col("processing_status") == "failed")
        .alias("retryable"),
    )


def recovery_plan(jobs: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Unfinished jobs: resume, or fail after too many attempts."""
    spent = F.col("attempts") >= max_attempts
    return jobs.filter(F.col("status").isin("queued", "running")).select(
        "job_id", "paper_id", "attempts", "created_at",
        F.when(spent, "fail").otherwise("resume").alias("action"),
        F.when(spent, STRANDED_MESSAGE).alias("error_message"),
    )


def failure_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAILURE_CODES), "error_code string, code_retryable boolean, code_message string")


def classify_failures(failures: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Transient or not, whether to retry now, what the reader is told.

    ``failures``: error_code, http_status, attempts. The code table has seven rows.
    """
    joined = failures.join(F.broadcast(failure_codes(failures.sparkSession)), "error_code", "left")
    transient = F.col("http_status").between(500, 599) | (F.col("http_status") == 429)
    return joined.select(
        *failures.columns,
        transient.alias("transient"),
        (transient & (F.col("attempts") < max_attempts)).alias("retry_now"),
        F.coalesce("code_retryable", F.lit(True)).alias("worth_retrying"),
        F.coalesce("code_message", F.lit(DEFAULT_MESSAGE)).alias("error_text"),
    )


def retry_schedule(jobs: DataFrame, max_attempts: int = MAX_ATTEMPTS, base_ms: int = RETRY_BASE_MS) -> DataFrame:
    """The attempts a job has left and the wait before each (2 s doubling)."""
    left = jobs.filter(F.col("attempts") < max_attempts)
    rows = left.select("job_id", "attempts", F.explode(F.sequence(F.col("attempts") + 1, F.lit(max_attempts))).alias("attempt"))
    wait = F.when(F.col("attempt") == 1, 0).otherwise(F.lit(base_ms) * F.pow(F.lit(2), F.col("attempt") - 2))
    return rows.withColumn("wait_ms", wait.cast("bigint"))


def reindex_plan(papers: DataFrame, jobs: DataFrame, limit: int = 25, version: int = INDEX_VERSION) -> tuple[DataFrame, DataFrame]:
    """I8: per user, the papers to rebuild now (oldest first, at most ``limit``) and the report.

    A paper with an active job is skipped; skipped papers count as busy only when
    they come before the last one queued. Only the top ``limit`` rows of a user
    meet in one place.
    """
    limit = max(1, min(limit, 200))
    outdated = papers.filter(
        (F.col("index_version") < version) & (F.col("processing_status") == "completed") & F.col("object_key").isNotNull()
    ).select("paper_id", "user_id", "created_at")
    active = jobs.filter(F.col("status").isin("queued", "running")).select("paper_id").distinct()
    idle = outdated.join(active, "paper_id", "left_anti")
    busy = outdated.join(active, "paper_id", "left_semi")
    order = Window.partitionBy("user_id").orderBy("created_at", "paper_id")
    queued = idle.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    last = queued.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("queued"), F.max(F.struct("created_at", "paper_id")).alias("last")
    )
    seen = busy.join(last, "user_id", "left").filter(
        (F.coalesce("queued", F.lit(0)) < limit) | (F.struct("created_at", "paper_id") < F.col("last"))
    ).groupBy("user_id").agg(F.count(F.lit(1)).alias("busy"))
    report = (
        outdated.groupBy("user_id").agg(F.count(F.lit(1)).alias("outdated"))
        .join(last.drop("last"), "user_id", "left").join(seen, "user_id", "left")
        .withColumns({"queued": F.coalesce("queued", F.lit(0)), "busy": F.coalesce("busy", F.lit(0))})
        .withColumn("remaining", F.col("outdated") - F.col("queued"))
    )
    return queued, report


def step_progress(events: DataFrame) -> DataFrame:
    """Progress of each job step from a nine-row table."""
    steps = events.sparkSession.createDataFrame(list(STEP_PROGRESS), "current_step string, step_progress int")
    return events.join(F.broadcast(steps), "current_step", "left")


def cross_owner_rows(child: DataFrame, parent: DataFrame, key: str, owner: str = "user_id") -> DataFrame:
    """Rows whose parent belongs to another user; a sound store has none."""
    other = parent.select(key, F.col(owner).alias("parent_owner"))
    return child.join(other, key).filter(F.col(owner) != F.col("parent_owner"))


def model_drift(chunks: DataFrame, current: str) -> tuple[DataFrame, DataFrame]:
    """Passages per embedding model, and the papers holding vectors of another model."""
    counts = chunks.groupBy("embedding_model").agg(F.count(F.lit(1)).alias("chunks"))
    stale = chunks.filter(~F.col("embedding_model").eqNullSafe(current)).groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("stale_chunks")
    )
    return counts, stale
