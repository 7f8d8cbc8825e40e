"""DuckDB text of the same input views, for the correctness checks."""

from __future__ import annotations

import re

from ..functions.defaults import SECTION_LABELS, TASK_SECTIONS

_SECTIONS = "[" + ", ".join(f"'{s}'" for s in SECTION_LABELS) + "]"

VIEWS = {
    "papers": """
        SELECT doc_id AS paper_id, doc_id % 8 AS user_id, source AS project_id,
               split_part(text, chr(10), 1) AS title,
               [['Ada','Bo','Cy','Di','Eve'][doc_id % 5 + 1] || ' ' || upper(left(source,1)) || substr(source,2),
                upper(left(lang,1)) || substr(lang,2) || ' Writer'] AS authors,
               [lang, source] AS tags,
               CASE WHEN doc_id % 11 <> 0 THEN 1990 + doc_id % 35 END AS publication_year,
               sha256(text) AS content_hash, n_chars AS file_size,
               CASE WHEN doc_id % 10 <> 2 THEN 'papers/' || doc_id % 8 || '/' || doc_id || '/original.pdf' END AS object_key,
               CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'queued' WHEN 2 THEN 'metadata_only' ELSE 'completed' END AS processing_status,
               ['to_read','reading','read'][doc_id % 3 + 1] AS reading_status,
               doc_id % 2 AS index_version,
               1704067200 + doc_id * 60 AS created_at,
               1704067200 + ((doc_id * 7919) % 100000) * 60 AS updated_at,
               text
        FROM documents""",
    "text_chunks": f"""
        SELECT doc_id || ':' || pos AS chunk_id, doc_id AS paper_id, doc_id % 8 AS user_id, pos AS chunk_index,
               {_SECTIONS}[(doc_id + pos) % 10 + 1] AS section_type, content
        FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS content,
                     unnest(range(len(str_split(text, chr(10))))) AS pos FROM documents)
        WHERE trim(content) <> ''""",
    "vec_chunks": f"""
        SELECT vec_id AS chunk_id, vec_id // 5 AS paper_id, (vec_id // 5) % 8 AS user_id, vec_id % 5 AS chunk_index,
               {_SECTIONS}[label + 1] AS section_type, label, embedding::DOUBLE[] AS embedding,
               CASE WHEN vec_id % 7 = 0 THEN 'encoder-v0' ELSE 'encoder-v1' END AS embedding_model
        FROM embeddings""",
    "library": """
        SELECT o_orderkey AS paper_id, o_custkey AS user_id, o_orderpriority AS project_id,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS processing_status,
               CASE WHEN o_orderkey % 13 <> 0 THEN year(o_orderdate) END AS publication_year,
               o_orderdate AS created_at
        FROM orders""",
    "concepts": """
        SELECT l_orderkey AS paper_id, p_name AS concept,
               ['keyword','method','dataset','metric','domain'][p_size % 5 + 1] AS concept_type,
               l_discount * 10 AS confidence, l_linenumber AS line_no, l_partkey AS part_id
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "ev": """
        SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM events""",
    "jobs": """
        SELECT event_id AS job_id, user_id * 5 + k % 5 AS paper_id,
               CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
               ['Queued','Preparing','Chunking','Storing index'][k % 4 + 1] AS current_step,
               k % 101 AS progress, k % 4 AS attempts, k % 3 <> 0 AS retryable,
               ['PDF_UNREADABLE','PDF_ENCRYPTED','NO_EXTRACTABLE_TEXT','PDF_TOO_COMPLEX','FILE_NOT_FOUND','AI_UNAVAILABLE','RATE_LIMITED','UNKNOWN'][k % 8 + 1] AS error_code,
               [422,429,500,503,404][k % 5 + 1] AS http_status,
               ts AS created_at
        FROM ev""",
    "analyses": """
        SELECT event_id AS analysis_id, user_id, 'p' || k % 6 AS project_id, user_id * 5 + k % 5 AS paper_id,
               ['summary','qa','comparison','research_gap','novelty','literature_review','concepts'][k % 7 + 1] AS analysis_type,
               'What about ' || event_type || ' ' || k AS input_query,
               ['fast-model','strong-model'][k % 2 + 1] AS model_id, ['groq','gemini'][k % 2 + 1] AS provider,
               sha256(event_type || '|' || k) AS cache_key, ts AS created_at
        FROM ev""",
    "works": """
        SELECT 'W' || doc_id AS external_id, split_part(text, chr(10), 1) AS title,
               CASE WHEN doc_id % 9 <> 0 THEN (doc_id * 37) % 1000 END AS cited_by_count,
               doc_id AS position, lang, source
        FROM documents""",
    "profiles": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, '{task}', [{', '.join(repr(s) for s in names)}]::VARCHAR[])"
        for i, (task, names) in enumerate(TASK_SECTIONS.items())
    )
    + ") AS t(task_no, task, sections)",
    "questions": """
        SELECT user_id * 100 + label AS query_id, user_id, task,
               sections, list(m ORDER BY i) AS embedding
        FROM (SELECT user_id, label, i, avg(x) AS m
              FROM (SELECT user_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM vec_chunks)
              GROUP BY ALL) JOIN profiles ON task_no = label % 7
        GROUP BY ALL""",
    "marked": """
        SELECT * REPLACE (CASE WHEN chunk_id % 11 = 3 THEN (user_id + 1) % 8 ELSE user_id END AS user_id,
                          CASE WHEN chunk_id % 13 = 5 THEN paper_id + 1000000000 ELSE paper_id END AS paper_id)
        FROM vec_chunks""",
    "scored": """
        SELECT query_id, q.user_id, task, chunk_id, c.paper_id, chunk_index, section_type,
               list_cosine_similarity(c.embedding, q.embedding) AS similarity,
               list_cosine_similarity(c.embedding, q.embedding)
                 * CASE WHEN list_contains(q.sections, section_type) THEN 1.25 ELSE 1.0 END AS score
        FROM marked c JOIN questions q ON c.user_id = q.user_id
        JOIN papers o ON o.paper_id = c.paper_id AND o.user_id = c.user_id""",
    "hits": """
        SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank,
               p.title AS paper_title, p.publication_year,
               coalesce(d.text, 'passage ' || chunk_id) AS content
        FROM (SELECT * FROM scored
              QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 8) s
        JOIN papers p ON p.paper_id = s.paper_id LEFT JOIN documents d ON d.doc_id = s.chunk_id""",
}


def sql(body: str, **extra: str) -> str:
    """``body`` preceded by the views it uses, each view once, in order."""
    views = {**VIEWS, **extra}
    order: list[str] = []

    def visit(text: str, name: str | None) -> None:
        for v in views:
            if v != name and v not in order and re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", text):
                visit(views[v], v)
                if v not in order:
                    order.append(v)

    visit(body, None)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{v} AS ({views[v].strip()})" for v in order)
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH ') :]}"
    return f"WITH RECURSIVE {ctes}\n{body}"
