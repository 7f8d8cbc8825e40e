"""Group L: windows and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import long
from ..sources import tables as T
from ..streaming import jobs as J
from ..streaming import windows as W
from ..session import shared_folder
from ..sources.versions import read_versions
from ..streaming import lifetime as LT
from .cleaning import SECTION_VIEWS
from .cutting import cut_views
from .duck import sql

DAYS3 = 3 * 86_400
KEYS = ["user_id", "event_type"]


def _stream(spark, folder, table):
    return J.stream_files(spark, folder, f"{table}.parquet", spark.read.parquet(f"{folder}/{table}.parquet").schema)


def _l1(spark, folder):
    # Every third paper comes twice in one batch, the old version with another text.
    versions = F.explode(F.filter(F.array(
        F.struct(F.lit(2).alias("arrived"), F.col("text")),
        F.struct(F.lit(1).alias("arrived"), F.concat(F.lit("zzz old version "), "text").alias("text")),
    ), lambda v: (v["arrived"] == 2) | (F.col("doc_id") % 3 == 0))).alias("v")
    docs = _stream(spark, folder, "documents").select(F.col("doc_id").alias("paper_id"), versions).select("paper_id", "v.*")
    base = f"{shared_folder(spark)}/index-{J.uuid.uuid4().hex}"
    J.index_stream(docs, f"{base}/chunks", f"{base}/state", arrival="arrived").awaitTermination()
    return read_versions(spark, f"{base}/chunks").select(
        "paper_id", long("chunk_index").alias("chunk_index"), "section_type", "content", long("token_count").alias("token_count"), long(F.size("embedding")).alias("dim"))


def _budget(df):
    return df.select("event_id", *KEYS, "number", "refused")


def _l2(spark, folder):
    return _budget(W.window_budget(T.read_events(spark, folder), KEYS, 2, seconds=DAYS3, block_seconds=86_400))


def _l2s(spark, folder):
    out = W.window_budget_stream(_stream(spark, folder, "events"), KEYS, 2, DAYS3)
    return _budget(spark.read.parquet(J.run_available(out, "budget")))


def _l3(spark, folder):
    ev = T.read_events(spark, folder).withColumn("lookup", F.concat(F.col("k") % 20, F.lit(":"), "event_type"))
    return W.lookup_replay(ev, ["lookup"], 6 * 3600).select("event_id", "lookup", "hit")


def _l4(spark, folder):
    jobs = _stream(spark, folder, "events").select(
        (F.col("user_id") * 5 + F.get_json_object("props", "$.k").cast("bigint") % 5).alias("paper_id"),
        F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))
    return read_versions(spark, J.run_available(J.job_states(jobs), "jobs", mode="update", key="paper_id")).select("paper_id", "job_id", "status")


def _l5(spark, folder):
    ups = _stream(spark, folder, "events").select("user_id", F.get_json_object("props", "$.k").alias("content_hash"), "ts")
    rows = spark.read.parquet(J.run_available(J.first_uploads(ups, "365 days"), "uploads"))
    return rows.select("user_id", "content_hash")


def _l5_lifetime(spark, folder):
    """The uploads as three batches a year apart: what came in an earlier batch is suppressed all the same."""
    ups = T.read_events(spark, folder).select("event_id", "user_id", F.col("k").cast("string").alias("content_hash"), "ts")
    table = f"{shared_folder(spark)}/lifetime-{J.uuid.uuid4().hex}"
    # To the nearest second as the SQL has it; a calendar year on, the 29th of February would fall on the 28th.
    day = F.floor(F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) / 86_400)
    for number in range(3):
        batch = ups.filter(F.pmod(day, F.lit(3)) == number)
        LT.store_first_uploads(batch.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {365 * number} DAY")), table, number, order=("ts", "event_id"))
    return read_versions(spark, table, "upload_key").select("user_id", "content_hash", "event_id")


def _l6(spark, folder):
    counts = J.activity_counts(_stream(spark, folder, "events"), "1 hour")
    rows = spark.read.parquet(J.run_available(counts, "activity"))
    return rows.select(F.unix_seconds("window_start").alias("window_start"), "user_id", "event_type", "events")


def _chain(keys: str, seconds: int, test: str) -> dict[str, str]:
    return {
        "ordered": f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS n FROM src",
        "steps": f"""
            SELECT {keys}, n, event_id, ts AS anchor, 1::BIGINT AS number FROM ordered WHERE n = 1
            UNION ALL
            SELECT {', '.join('o.' + k.strip() for k in keys.split(','))}, o.n, o.event_id,
                   CASE WHEN o.ts {test} s.anchor + INTERVAL {seconds} SECOND THEN o.ts ELSE s.anchor END,
                   CASE WHEN o.ts {test} s.anchor + INTERVAL {seconds} SECOND THEN 1 ELSE s.number + 1 END
            FROM steps s JOIN ordered o ON {' AND '.join(f'o.{k.strip()} = s.{k.strip()}' for k in keys.split(','))} AND o.n = s.n + 1""",
    }


_BUDGET = sql("SELECT event_id, user_id, event_type, number, number > 2 AS refused FROM steps",
              **_chain("user_id, event_type", DAYS3, ">"), src="SELECT * FROM ev")

QUERIES = {
    "l1_incremental_index": (_l1, sql("""
        SELECT paper_id, chunk_index, section_type, content, token_count, 384::BIGINT AS dim FROM passages""", **{
        **SECTION_VIEWS, **cut_views(256, 64, 50), "headed": "SELECT doc_id AS paper_id, text FROM documents",
        "sect": "SELECT paper_id, order_index AS section_index, section_type, content FROM secs"})),
    "l2_window_budget": (_l2, _BUDGET),
    "l2_window_budget_stream": (_l2s, _BUDGET),
    "l3_lookup_ttl": (_l3, sql("SELECT event_id, lookup, number > 1 AS hit FROM steps",
        **_chain("lookup", 6 * 3600, ">="), src="SELECT *, (k % 20) || ':' || event_type AS lookup FROM ev")),
    "l4_job_state": (_l4, sql("""
        SELECT user_id * 5 + k % 5 AS paper_id, max_by(event_id, (ts, event_id)) AS job_id, max_by(event_type, (ts, event_id)) AS status FROM ev GROUP BY 1""")),
    "l5_upload_suppression": (_l5, sql("SELECT DISTINCT user_id, k::VARCHAR AS content_hash FROM ev")),
    "l5_lifetime_suppression": (_l5_lifetime, sql("""
        SELECT user_id, k::VARCHAR AS content_hash, arg_min(event_id, (b, ts, event_id)) AS event_id
        FROM (SELECT *, (epoch(ts)::BIGINT // 86400) % 3 AS b FROM ev) GROUP BY user_id, k""")),
    "l6_activity_counts": (_l6, sql("""
        SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, user_id, event_type, count(*) AS events FROM ev
        GROUP BY ALL HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ev)""")),
}
