"""Group A: sources, uploads, table maintenance, sinks."""

from __future__ import annotations

import uuid

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import long
from ..operators import library as L
from ..operators import maintenance as M
from ..sources import sinks, uploads, versions
from ..session import shared_folder
from ..sources import tables as T
from .duck import sql


def upload_rows(spark, folder):
    """Documents as uploaded files of six kinds: sound, junk before the marker, marker too late, text, empty."""
    d, text = F.col("doc_id"), F.col("text")
    content = (
        F.when(d % 6 == 0, F.concat(F.lit("%PDF-1.7\n"), text))
        .when(d % 6 == 1, F.concat(F.repeat(F.lit(" "), 500), F.lit("%PDF-1.4"), text))
        .when(d % 6 == 2, F.concat(F.repeat(F.lit("x"), 2000), F.lit("%PDF-1.4")))
        .when(d % 6 == 3, text).when(d % 6 == 4, F.lit("")).otherwise(F.concat(F.lit("%PDF-"), text)))
    name = (
        F.when(d % 7 == 0, F.concat(F.lit("attention_is_all-you__need_"), d, F.lit(".pdf")))
        .when(d % 7 == 1, F.concat(F.lit("../../etc/"), "source", F.lit(".PDF")))
        .when(d % 7 == 2, F.concat(F.lit("C:\\Users\\x\\"), "lang", F.lit("-paper.pdf")))
        .when(d % 7 == 3, F.lit("   ")).when(d % 7 == 4, F.lit(".pdf"))
        .when(d % 7 == 5, F.regexp_replace(text, "[/\\\\\n]", " ")))
    return T.scan(spark, folder, "documents").select(
        d.alias("upload_id"), (d % 8).alias("user_id"), name.alias("filename"), F.encode(content, "UTF-8").alias("content"))


_UP = {"ups": """
    SELECT doc_id AS upload_id, doc_id % 8 AS user_id,
      CASE doc_id % 7 WHEN 0 THEN 'attention_is_all-you__need_' || doc_id || '.pdf' WHEN 1 THEN '../../etc/' || source || '.PDF'
        WHEN 2 THEN 'C:\\Users\\x\\' || lang || '-paper.pdf' WHEN 3 THEN '   ' WHEN 4 THEN '.pdf'
        WHEN 5 THEN regexp_replace(text, '[/\\\\\\n]', ' ', 'g') END AS filename,
      CASE doc_id % 6 WHEN 0 THEN '%PDF-1.7' || chr(10) || text WHEN 1 THEN repeat(' ', 500) || '%PDF-1.4' || text
        WHEN 2 THEN repeat('x', 2000) || '%PDF-1.4' WHEN 3 THEN text WHEN 4 THEN '' ELSE '%PDF-' || text END AS content
    FROM documents"""}


def _a1(spark, folder):
    cols = {"orders": ["o_orderkey"], "documents": ["doc_id"], "embeddings": ["vec_id"], "events": ["event_id"],
            "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id"]}
    parts = [
        T.scan(spark, folder, t, c).agg(F.count(F.lit(1)).alias("rows"), F.sum(c[0]).alias("key_sum"))
        .select(F.lit(t).alias("table_name"), "rows", "key_sum") for t, c in cols.items()]
    return reduce(DataFrame.unionByName, parts)


def _a2(spark, folder):
    return upload_rows(spark, folder).select("upload_id", uploads.looks_like_pdf(F.col("content")).alias("is_pdf"))


def _a3(spark, folder):
    return uploads.validate_uploads(upload_rows(spark, folder), 5000).select("upload_id", "reject_code")


def _a4(spark, folder):
    return upload_rows(spark, folder).select("upload_id", uploads.fingerprint(F.col("content")).alias("content_hash"))


def _a5(spark, folder):
    return upload_rows(spark, folder).select("upload_id", uploads.title_from_filename(F.col("filename")).alias("title"))


def _a6(spark, folder):
    return upload_rows(spark, folder).select("upload_id", uploads.object_key(F.col("user_id"), F.col("upload_id")).alias("object_key"))


def _a7(spark, folder):
    c = T.read_text_chunks(spark, folder).select("paper_id", "chunk_index", "content")
    outdated = T.read_papers(spark, folder).filter("index_version = 0").select("paper_id")
    new = c.join(outdated, "paper_id", "left_semi").groupBy("paper_id").agg(
        F.min("chunk_index").alias("chunk_index"), F.concat(F.lit("rebuilt: "), F.min_by("content", "chunk_index")).alias("content"))
    return M.replace_rows(c, new).select("paper_id", long("chunk_index").alias("chunk_index"), "content")


def _a7_table(spark, folder):
    """The same replacement in a stored table, twice, with a text of the second run that stays."""
    c = T.read_text_chunks(spark, folder).select("paper_id", "chunk_index", "content")
    outdated = T.read_papers(spark, folder).filter("index_version = 0").select("paper_id")
    new = c.join(outdated, "paper_id", "left_semi").groupBy("paper_id").agg(
        F.min("chunk_index").alias("chunk_index"), F.concat(F.lit("rebuilt: "), F.min_by("content", "chunk_index")).alias("content"))
    path = f"{shared_folder(spark)}/replaced-{uuid.uuid4().hex}"
    sinks.write_bucketed(c, path, buckets=8)
    sinks.replace_in_table(spark, new.withColumn("content", F.lit("first run")), path)
    sinks.replace_in_table(spark, new, path)
    return sinks.read_bucketed(spark, path).select("paper_id", long("chunk_index").alias("chunk_index"), "content")


def _a7_versions(spark, folder):
    """The same replacement by appended versions, failed papers deleted by another, then compacted and swept."""
    c = T.read_text_chunks(spark, folder).select("paper_id", "chunk_index", "content")
    papers = T.read_papers(spark, folder)
    new = c.join(papers.filter("index_version = 0").select("paper_id"), "paper_id", "left_semi").groupBy("paper_id").agg(
        F.min("chunk_index").alias("chunk_index"), F.concat(F.lit("rebuilt: "), F.min_by("content", "chunk_index")).alias("content"))
    path = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    versions.append_version(c, path, buckets=8)
    versions.append_version(new, path)
    versions.append_version(c.limit(0), path, gone=papers.filter("processing_status = 'failed'").select("paper_id"))
    versions.compact(spark, path, dead_share=0.1)
    versions.vacuum(spark, path)
    return versions.read_versions(spark, path).select("paper_id", long("chunk_index").alias("chunk_index"), "content")


def _a8(spark, folder):
    c = T.read_concepts(spark, folder).withColumn("confidence", F.round("confidence", 2))
    keys = ["paper_id", "concept", "concept_type"]
    cols = [*keys, "confidence"]
    stored = M.first_per_key(c.filter("line_no <= 2"), keys, ["line_no", "part_id", "confidence"]).select(*cols)
    return M.insert_ignore(stored, c.filter("line_no > 2"), keys, ["line_no", "part_id", "confidence"])


def _stored(spark, folder):
    a = T.read_analyses(spark, folder)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return a.filter(F.col("created_at") < cut), a.filter(F.col("created_at") >= cut)


def _a9(spark, folder):
    stored, fresh = _stored(spark, folder)
    once = M.first_per_key(stored, ["user_id", "cache_key"], ["created_at", "analysis_id"])
    return M.upsert_results(once, fresh).select("user_id", "cache_key", "analysis_id", "analysis_type")


def _a10(spark, folder):
    papers = T.read_papers(spark, folder).drop("text")
    analyses = T.read_analyses(spark, folder).drop("project_id").join(papers.select("paper_id", "project_id"), "paper_id")
    kept = M.delete_papers(
        {"papers": papers, "chunks": T.read_text_chunks(spark, folder), "concepts": T.read_concepts(spark, folder),
         "jobs": T.read_jobs(spark, folder), "analyses": analyses},
        papers.filter("processing_status = 'failed'"))
    doomed = papers.filter("project_id IN ('src3', 'src11')").select("user_id", "project_id")
    p2, a2, released = M.delete_projects(papers, analyses.drop("user_id").join(papers.select("paper_id", "user_id"), "paper_id"), doomed)
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("paper_id"), F.lit(0)).alias("id_sum")).select(F.lit(n).alias("item"), "rows", "id_sum")
             for n, df in kept.items()]
    parts.append(p2.filter("project_id IS NULL").agg(F.count(F.lit(1)).alias("rows"), F.sum("paper_id").alias("id_sum")).select(F.lit("released papers").alias("item"), "rows", "id_sum"))
    parts.append(a2.agg(F.count(F.lit(1)).alias("rows"), F.sum("paper_id").alias("id_sum")).select(F.lit("analyses after projects").alias("item"), "rows", "id_sum"))
    parts.append(released.select(F.concat_ws(" ", F.lit("released"), "user_id", "project_id").alias("item"), F.col("released").alias("rows"), F.lit(0).cast("bigint").alias("id_sum")))
    return reduce(DataFrame.unionByName, parts)


def _a11(spark, folder):
    w = T.read_works(spark, folder)
    req = w.select(
        F.lit(1).cast("bigint").alias("user_id"), F.col("source").alias("project_id"), F.concat(F.lit("W"), F.floor(F.col("position") / 2)).alias("external_id"),
        F.when(F.col("position") % 4 != 3, F.col("title")).alias("title"),
        F.array(F.concat(F.lit("Zed "), "lang"), F.lit(" "), F.concat(F.lit("Amy "), "source")).alias("authors"), "position")
    stored = req.filter(F.col("project_id").isin("src2", "src5")).select("user_id", "project_id", "external_id")
    return M.import_catalogue(req, stored).select(
        "project_id", "external_id", "title", F.array_join("authors", "|").alias("authors"), "processing_status", "reject_code")


def _a12(spark, folder):
    p = T.read_papers(spark, folder).drop("text")
    d = F.col("paper_id")
    edits = p.select(
        "paper_id", F.when(d % 9 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        F.when(d % 4 == 0, F.concat(F.lit("  New title of "), "project_id", F.lit(" "))).when(d % 4 == 1, F.lit("  ")).alias("title"),
        F.when(d % 3 == 0, F.array(F.lit(" x "), F.lit("x"), F.lit("  "), F.col("project_id"))).alias("tags"),
        F.when(d % 5 == 0, "read").when(d % 5 == 1, "skimmed").alias("reading_status"))
    return L.apply_edits(p, edits).select("paper_id", "title", F.array_join("tags", "|").alias("tags"), "reading_status", "edit_error")


def _a13(spark, folder):
    p = T.read_library(spark, folder).select("paper_id", "user_id", "project_id", "processing_status")
    return sinks.json_rows(p)


_FIRST = "row_number() OVER (PARTITION BY paper_id, concept, concept_type ORDER BY line_no, part_id, confidence) AS rn"

QUERIES = {
    "a1_table_scan": (_a1, " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows, sum({k})::BIGINT AS key_sum FROM {t}" for t, k in
        (("orders", "o_orderkey"), ("documents", "doc_id"), ("embeddings", "vec_id"), ("events", "event_id"), ("pages", "page_id"),
         ("benchmark", "item_id"), ("labels", "doc_id"), ("conversations", "conv_id")))),
    "a2_file_marker": (_a2, sql("SELECT upload_id, contains(left(content, 1024), '%PDF-') AS is_pdf FROM ups", **_UP)),
    "a3_upload_validation": (_a3, sql("""
        SELECT upload_id, CASE WHEN content = '' THEN 'EMPTY_FILE' WHEN strlen(content) > 5000 THEN 'FILE_TOO_LARGE'
               WHEN NOT contains(left(content, 1024), '%PDF-') THEN 'UNSUPPORTED_FILE_TYPE' END AS reject_code FROM ups""", **_UP)),
    "a4_fingerprint": (_a4, sql("SELECT upload_id, sha256(content) AS content_hash FROM ups", **_UP)),
    "a5_filename_title": (_a5, sql("""
        SELECT upload_id, coalesce(nullif(left(trim(regexp_replace(replace(replace(
                 regexp_replace(regexp_replace(filename, '^.*[/\\\\]', '', 's'), '\\.pdf$', '', 'i'), '_', ' '), '-', ' '), '\\s+', ' ', 'g')), 300), ''),
               'Untitled paper') AS title FROM ups""", **_UP)),
    "a6_object_key": (_a6, "SELECT doc_id AS upload_id, 'papers/' || doc_id % 8 || '/' || doc_id || '/original.pdf' AS object_key FROM documents"),
    "a7_replace_on_reindex": (_a7, sql("""
        SELECT paper_id, chunk_index, CASE WHEN paper_id % 2 = 0 THEN 'rebuilt: ' || content ELSE content END AS content FROM text_chunks
        WHERE paper_id % 2 = 1 OR chunk_index = (SELECT min(t.chunk_index) FROM text_chunks t WHERE t.paper_id = text_chunks.paper_id)""")),
    "a7_replace_in_table": (_a7_table, sql("""
        SELECT paper_id, chunk_index, CASE WHEN paper_id % 2 = 0 THEN 'rebuilt: ' || content ELSE content END AS content FROM text_chunks
        WHERE paper_id % 2 = 1 OR chunk_index = (SELECT min(t.chunk_index) FROM text_chunks t WHERE t.paper_id = text_chunks.paper_id)""")),
    "a7_appended_versions": (_a7_versions, sql("""
        SELECT paper_id, chunk_index, CASE WHEN paper_id % 2 = 0 THEN 'rebuilt: ' || content ELSE content END AS content FROM text_chunks
        WHERE paper_id % 10 <> 0 AND (paper_id % 2 = 1 OR chunk_index = (SELECT min(t.chunk_index) FROM text_chunks t WHERE t.paper_id = text_chunks.paper_id))""")),
    "a8_insert_ignore": (_a8, sql(f"""
        WITH c AS (SELECT * REPLACE (round(confidence, 2) AS confidence) FROM concepts),
             s AS (SELECT * FROM (SELECT *, {_FIRST} FROM c WHERE line_no <= 2) WHERE rn = 1),
             n AS (SELECT * FROM (SELECT *, {_FIRST} FROM c WHERE line_no > 2) WHERE rn = 1)
        SELECT paper_id, concept, concept_type, confidence FROM s
        UNION ALL SELECT paper_id, concept, concept_type, confidence FROM n ANTI JOIN s USING (paper_id, concept, concept_type)""")),
    "a9_upsert_result": (_a9, sql("""
        SELECT user_id, cache_key, analysis_id, analysis_type FROM analyses
        QUALIFY row_number() OVER (PARTITION BY user_id, cache_key ORDER BY created_at >= TIMESTAMP '2024-01-16', created_at, analysis_id) = 1""")),
    "a10_cascade_delete": (_a10, sql("""
        WITH alive AS (SELECT paper_id FROM papers WHERE processing_status <> 'failed'),
             dead AS (SELECT paper_id FROM papers WHERE processing_status = 'failed'),
             an AS (SELECT a.paper_id, p.project_id, p.user_id FROM analyses a JOIN papers p ON a.paper_id = p.paper_id)
        SELECT 'papers' AS item, count(*) AS rows, sum(paper_id)::BIGINT AS id_sum FROM papers WHERE paper_id IN (FROM alive)
        UNION ALL SELECT 'chunks', count(*), sum(paper_id)::BIGINT FROM text_chunks WHERE paper_id NOT IN (FROM dead)
        UNION ALL SELECT 'concepts', count(*), sum(paper_id)::BIGINT FROM concepts WHERE paper_id NOT IN (FROM dead)
        UNION ALL SELECT 'jobs', count(*), sum(paper_id)::BIGINT FROM jobs WHERE paper_id NOT IN (FROM dead)
        UNION ALL SELECT 'analyses', count(*), sum(paper_id)::BIGINT FROM an WHERE paper_id NOT IN (FROM dead)
        UNION ALL SELECT 'released papers', count(*), sum(paper_id)::BIGINT FROM papers WHERE project_id IN ('src3', 'src11')
        UNION ALL SELECT 'analyses after projects', count(*), sum(paper_id)::BIGINT FROM an WHERE project_id NOT IN ('src3', 'src11')
        UNION ALL SELECT 'released ' || user_id || ' ' || project_id, count(*), 0 FROM papers WHERE project_id IN ('src3', 'src11') GROUP BY user_id, project_id""")),
    "a11_catalogue_import": (_a11, """
        SELECT source AS project_id, 'W' || doc_id // 2 AS external_id,
               CASE WHEN doc_id % 4 <> 3 AND trim(split_part(text, chr(10), 1)) <> '' THEN split_part(text, chr(10), 1) ELSE 'Untitled paper' END AS title,
               'Amy ' || source || '|Zed ' || lang AS authors,
               CASE WHEN source NOT IN ('src2', 'src5') THEN 'metadata_only' END AS processing_status,
               CASE WHEN source IN ('src2', 'src5') THEN 'DUPLICATE_PAPER' END AS reject_code
        FROM documents QUALIFY row_number() OVER (PARTITION BY source, doc_id // 2 ORDER BY doc_id) = 1"""),
    "a12_attribute_update": (_a12, sql("""
        SELECT paper_id, CASE WHEN ok AND paper_id % 4 = 0 THEN 'New title of ' || project_id ELSE title END AS title,
               CASE WHEN ok AND paper_id % 3 = 0 THEN 'x|' || project_id ELSE array_to_string(tags, '|') END AS tags,
               CASE WHEN ok AND paper_id % 5 = 0 THEN 'read' ELSE reading_status END AS reading_status,
               CASE WHEN paper_id % 9 <> 0 AND paper_id % 5 = 1 THEN 'INVALID_READING_STATUS' END AS edit_error
        FROM (SELECT *, paper_id % 9 <> 0 AND paper_id % 5 <> 1 AS ok FROM papers)""")),
    "a13_json_rows": (_a13, sql("""
        SELECT '{"paper_id":' || paper_id || ',"user_id":' || user_id || ',"project_id":"' || project_id || '","processing_status":"' || processing_status || '"}' AS value FROM library""")),
}
