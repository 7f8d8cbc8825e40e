"""The contract's queries over the operators of this package, and their DuckDB twins where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .bpe import decode, encode
from .caps import vector_groups
from .contamination import find_contamination
from .exact import exact_groups
from .html import extract_text
from .jaccard import jaccard_groups
from .lexical import rank_documents
from .licenses import find_licenses
from .pii import replace_personal_data
from .quality import classify_quality
from .repeats import find_repeats
from .trie import conversation_trie
from .urls import judge_urls

#: The host rules of the URL filter.
HOST_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

#: Key of the registered query; a deployment passes its own secret.
PSEUDONYM_KEY = b"registered query, not a secret"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, HOST_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = find_licenses(table(spark, folder, "documents"))
    return found.select("doc_id", F.concat_ws(",", "licenses").alias("licenses"), F.size("notices").alias("n_notices"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = decode(encode(table(spark, folder, "documents"), path), path)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    groups = jaccard_groups(table(spark, folder, "documents"), k=4, num=85, den=100)
    return groups.select("doc_id", "n_shingles", "component_id")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), size=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = find_repeats(table(spark, folder, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = classify_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_chars", "perplexity", "score", "threshold", "keep")


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    replaced = replace_personal_data(table(spark, folder, "documents"), PSEUDONYM_KEY)
    kinds = F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["kind"]))))
    return replaced.select("doc_id", "n_replaced", kinds.alias("kinds"), "text")


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(table(spark, folder, "conversations"))


def op12_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_groups(table(spark, folder, "embeddings"), least=0.93)


def op13_ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL = {
    "op1_url_filters": f"""
        WITH parsed AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), {_A_Z}) AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages),
        rules(rule, rule_host, rule_path, action) AS (VALUES
            ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
            ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
            ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
        fitting AS (
            SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
            FROM (SELECT DISTINCT host, path FROM parsed)
            JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY host, path)
        SELECT page_id, parsed.host, parsed.path, rule,
               coalesce(action, CASE WHEN regexp_matches(parsed.host,
                   '(^|[^a-z0-9])(adult|spam|casino|malware)($|[^a-z0-9])') THEN 'block' ELSE 'allow' END) AS verdict
        FROM parsed LEFT JOIN fitting ON parsed.host = fitting.host AND parsed.path = fitting.path""",
    "op4_ngram_jaccard": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
        FROM w LEFT JOIN sizes s ON w.doc_id = s.doc_id
        LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = w.doc_id""",
    "op5_decontamination": rf"""
        WITH doc_words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_Z}),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        item_words AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_A_Z}),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
            FROM (SELECT item_id, w, least(len(w), 10) AS size,
                         unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)),
        spots AS (
            SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
                  FROM doc_words, (SELECT DISTINCT size FROM windows))),
        hits AS (SELECT doc_id, i, s.size, item_id FROM spots s JOIN windows v ON s.size = v.size AND s.phrase = v.phrase),
        counted AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                    FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words d LEFT JOIN counted c ON d.doc_id = c.doc_id LEFT JOIN items n ON d.doc_id = n.doc_id""",
    "op8_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {_A_Z}) AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.text) AS text_sha256
        FROM t JOIN g ON t.text = g.text""",
    "op11_conversation_trie": """
        WITH RECURSIVE turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS turns FROM turns GROUP BY conv_id),
        heads AS (
            SELECT conv_id, turns, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i:
                    CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) % 6 AS h
            FROM own),
        built AS (
            SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1 : h.h], h.turns[h.h + 1 :]) AS turns
            FROM heads h LEFT JOIN own b ON b.conv_id = h.base),
        starts AS (
            SELECT conv_id, d AS depth, turns[1 : d] AS start, len(turns) = d AS is_last
            FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
        nodes AS (
            SELECT depth, start, min(conv_id) AS node, count(*) AS n_convs, CASE WHEN depth = 0 THEN 0 ELSE
                       (count(*) - 1) * length(start[depth].text) END AS saving,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_last), '')) AS ends_sha256
            FROM starts GROUP BY depth, start),
        member AS (SELECT s.conv_id, n.depth, n.node FROM starts s JOIN nodes n ON s.depth = n.depth AND s.start = n.start),
        linked AS (
            SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN member m ON m.conv_id = n.node AND m.depth = n.depth - 1),
        kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY parent, depth),
        sized AS (SELECT l.*, coalesce(k.n, 0) AS n_children FROM linked l LEFT JOIN kids k ON k.parent = l.node AND k.depth = l.depth),
        below AS (
            SELECT m.node, m.depth, sum(u.saving) AS saved, count(*) FILTER (u.n_children = 0) AS leaves
            FROM sized u JOIN member m ON m.conv_id = u.node AND m.depth <= u.depth GROUP BY m.node, m.depth)
        SELECT s.node AS conv_id, s.depth::BIGINT AS depth, s.parent AS parent_conv_id, s.n_convs, s.n_children,
               b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, s.ends_sha256
        FROM sized s JOIN below b ON b.node = s.node AND b.depth = s.depth""",
    # Cosines of all pairs; equal to the operator's rows where its filters meet every link, as on the given tables.
    "op12_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0
               AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
            AND list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT reach.a, min(v.vec_id) AS m FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
        counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
               coalesce(vec_id = least(vec_id, coalesce(m, vec_id)), true) AS kept
        FROM v LEFT JOIN counted c ON c.a = v.r LEFT JOIN least l ON l.a = v.r""",
    "op13_ranked_lexical_search": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_Z}),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (
            SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), {_A_Z}),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
        asked AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
        totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
        tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d)
               WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
        weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight
                    FROM tf, totals GROUP BY t),
        parts AS (SELECT r, doc_id, 25 + (75 * len(w) * n_docs) // total AS m FROM d, totals WHERE len(w) > 0),
        scores AS (
            SELECT q, item_id, doc_id, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM asked JOIN tf USING (t) JOIN weights USING (t) JOIN parts USING (r) GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank
            FROM scores WHERE score > 0) WHERE rank <= 10""",
}

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_license_scans": op2_license_scans,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}
