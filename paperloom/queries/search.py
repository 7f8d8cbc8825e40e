"""Group E: retrieval, keyword search, listings."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ..functions.columns import long
from ..functions.vectors import cosine_similarity
from ..operators import keyword as K
from ..operators import keyword_index as KI
from ..operators import library as L
from ..operators import retrieval as R
from ..operators import vector_cells as V
from ..session import shared_folder
from ..sources import tables as T
from .duck import sql


def questions(spark, folder):
    """One question per user and section label: the mean vector of its passages."""
    chunks = T.read_vector_chunks(spark, folder).select(
        "user_id", "section_type",
        array_to_vector("embedding").alias("v"),
    )
    label = F.array_position(F.array(*[F.lit(s) for s in T.SECTION_LABELS]), F.col("section_type")) - 1
    means = chunks.groupBy("user_id", label.alias("label")).agg(Summarizer.mean(F.col("v")).alias("m"))
    profiles = F.broadcast(R.task_profiles(spark))
    return means.join(profiles, F.col("task_no") == F.col("label") % 7).select(
        (F.col("user_id") * 100 + F.col("label")).alias("query_id"),
        "user_id", "task", "sections", vector_to_array("m").alias("embedding"), F.lit(8).alias("top_k"),
    )


def marked_chunks(spark, folder):
    """Passages of which some carry a wrong owner and some belong to no paper."""
    chunk = F.col("chunk_id")
    return T.read_vector_chunks(spark, folder).withColumns({
        "user_id": F.when(chunk % 11 == 3, (F.col("user_id") + 1) % 8).otherwise(F.col("user_id")),
        "paper_id": F.when(chunk % 13 == 5, F.col("paper_id") + 1_000_000_000).otherwise(F.col("paper_id"))})


def raw_hits(spark, folder, qs=None):
    return R.search(
        marked_chunks(spark, folder), T.read_papers(spark, folder).drop("text"),
        questions(spark, folder) if qs is None else qs,
    )


def hits(spark, folder, qs=None):
    """Ranked hits with passage text."""
    content = T.read_vector_content(spark, folder)
    found = raw_hits(spark, folder, qs).join(content, "chunk_id", "left")
    return found.withColumn("content", F.coalesce("content", F.concat(F.lit("passage "), "chunk_id")))


def _e1(spark, folder):
    c = T.read_vector_chunks(spark, folder)
    first = c.filter("chunk_index = 0").select("paper_id", F.col("embedding").alias("opening"))
    return c.join(first, "paper_id").select(
        "chunk_id", F.round(cosine_similarity(F.col("embedding"), F.col("opening")), 4).alias("similarity")
    )


def _shown(df, *extra):
    return df.select(
        "query_id", long("rank").alias("rank"), "chunk_id", "paper_id", "section_type",
        long("chunk_index").alias("chunk_index"), F.round("similarity", 4).alias("similarity"),
        F.round("score", 4).alias("score"), *extra,
    )


def _e2(spark, folder):
    plain = questions(spark, folder).drop("sections")
    return _shown(raw_hits(spark, folder, plain), "paper_title", long("publication_year").alias("publication_year"))


def _e3(spark, folder):
    return _shown(raw_hits(spark, folder))


def _filtered(spark, folder):
    label = F.col("query_id") % 100
    return questions(spark, folder).withColumns(
        {
            "want_tag": F.when(label % 2 == 0, "en"),
            "want_project": F.when(label % 5 == 1, "src3"),
            "want_year": F.when(label % 5 == 3, 2000 + F.col("user_id")).cast("int"),
            "want_paper": F.when(label == 9, F.col("user_id") + 16),
        }
    )


def _e4(spark, folder):
    return _shown(raw_hits(spark, folder, _filtered(spark, folder)))


def _e4_cells(spark, folder):
    """The filtered questions over stored cells of at most 64 passages."""
    chunks = marked_chunks(spark, folder)
    owned = T.read_papers(spark, folder).select("paper_id", "user_id", "project_id", "publication_year", "tags")
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    V.store_cells(chunks.join(owned, ["paper_id", "user_id"]), path, cell_rows=64, slots=8)
    ranked, _ = V.search_cells(spark, path, _filtered(spark, folder).withColumnRenamed("query_id", "probe_id"))
    return _shown(ranked.withColumnRenamed("probe_id", "query_id").join(chunks.drop("embedding", "user_id"), "chunk_id"))


def scopes(spark, folder):
    p = T.read_papers(spark, folder)
    per_user = p.select("user_id").distinct().select(
        F.concat(F.lit("u"), "user_id").alias("scope_id"), "user_id",
        F.lit(None).cast("string").alias("project_id"), F.lit(None).cast("bigint").alias("paper_id"))
    per_project = p.select("user_id", "project_id").distinct().select(
        F.concat_ws("-", F.lit("p"), "user_id", "project_id").alias("scope_id"), "user_id", "project_id",
        F.lit(None).cast("bigint").alias("paper_id"))
    per_paper = p.select(
        F.concat_ws("-", F.lit("d"), "paper_id").alias("scope_id"), "user_id",
        F.lit(None).cast("string").alias("project_id"), "paper_id")
    return per_user.unionByName(per_project).unionByName(per_paper)


def _e5(spark, folder):
    return R.corpus_sizes(T.read_papers(spark, folder), scopes(spark, folder)).select("scope_id", "corpus_size")


def _e6(spark, folder):
    qs = questions(spark, folder)
    return R.evidence_strength(qs, raw_hits(spark, folder, qs), 0.5).select(
        "query_id", "n_hits", F.round("best_similarity", 4).alias("best_similarity"), "sufficient")


def _e7(spark, folder):
    """Every paper's owner asks for its own passages and those of the next paper (another owner)."""
    c = T.read_text_chunks(spark, folder)
    own = c.select((F.col("paper_id") + 0).alias("request_id"), F.col("user_id"), "chunk_id")
    foreign = c.filter("paper_id > 0").select(
        (F.col("paper_id") - 1).alias("request_id"), ((F.col("paper_id") - 1) % 8).alias("user_id"), "chunk_id")
    req = own.unionByName(foreign).groupBy("request_id", "user_id").agg(F.collect_set("chunk_id").alias("chunk_ids"))
    return R.reload_chunks(req, c, T.read_papers(spark, folder).drop("text")).select(
        "request_id", long("position").alias("position"), "chunk_id", "paper_title")


def _e10(spark, folder):
    p = T.read_papers(spark, folder)
    abstract = F.when(F.col("paper_id") % 3 != 0, F.col("text"))
    title = F.when(F.col("paper_id") % 6 != 0, F.col("title"))
    return p.select("paper_id", R.retrieval_text(title, abstract).alias("query_text"))


def _e11(spark, folder):
    a = T.read_analyses(spark, folder).select(
        F.col("analysis_id").alias("request_id"),
        F.when(F.col("analysis_type") == "concepts", "keyword_extraction").otherwise(F.col("analysis_type")).alias("task"),
        F.when(F.col("analysis_id") % 3 != 0, (F.col("paper_id") % 30).cast("int")).alias("requested_k"))
    return R.plan_retrieval(a, R.task_plans(spark)).select("request_id", "task", long("top_k").alias("top_k"))


def _e12(spark, folder):
    qs = questions(spark, folder).withColumn("want_tag", F.when(F.col("query_id") % 3 == 0, "xx"))
    strength = R.evidence_strength(qs, raw_hits(spark, folder, qs), 0.5).join(qs.select("query_id", "task"), "query_id")
    gate = R.evidence_gate(strength.withColumn("single_paper", F.col("query_id") % 2 == 0))
    return gate.select("query_id", "task", "n_hits", "gate")


def keyword_asks(spark, folder):
    """Every user's library of whole documents, and every benchmark passage asked of each."""
    docs = T.read_papers(spark, folder, for_text=True).select(
        F.col("paper_id").alias("chunk_id"), "paper_id", "user_id", F.col("text").alias("content"), "title", "project_id")
    asks = T.scan(spark, folder, "benchmark").select("item_id", "text")
    users = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("user_id")
    qs = asks.select("item_id", "text", users).select(
        (F.col("item_id") * 10 + F.col("user_id")).alias("query_id"), F.col("user_id").cast("bigint").alias("user_id"),
        # Of the words asked for, every other one is inflected once more.
        F.array_join(F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), lambda w, i: F.when(
            (i % 2 == 0) & w.rlike("^.{2,}[ntrdhgl]$") & ~F.lower(w).isin(*K.STOP_WORDS), F.concat(w, F.lit("s"))
        ).otherwise(w)), " ").alias("text"),
        F.when(F.col("item_id") % 4 == 0, "src3").alias("want_project"))
    return docs, qs


def keyword_hits(spark, folder):
    return K.keyword_search(*keyword_asks(spark, folder))


def _e8_index(spark, folder):
    """The same questions to an index in which every third document was first another text."""
    docs, qs = keyword_asks(spark, folder)
    third = F.col("paper_id") % 3 == 0
    path = f"{shared_folder(spark)}/keywords-{uuid.uuid4().hex}"
    KI.update_index(docs.withColumn("content", F.when(third, F.concat(F.lit("zzz older words "), "title")).otherwise(F.col("content"))),
                    path, slices=4, buckets=8)
    KI.update_index(docs.filter(third), path)
    found, _ = KI.search_index(spark, path, qs)
    return found.select("query_id", long("rank").alias("rank"), "chunk_id", F.round("text_rank", 4).alias("text_rank"))


def _e8(spark, folder):
    return keyword_hits(spark, folder).select(
        "query_id", long("rank").alias("rank"), "chunk_id", F.round("text_rank", 4).alias("text_rank"))


def _e9(spark, folder):
    return keyword_hits(spark, folder).select("query_id", "chunk_id", K.snippet(F.col("content"), F.col("terms")).alias("snippet"))


def _e9_fragment(spark, folder):
    return keyword_hits(spark, folder).select(
        "query_id", "chunk_id", K.covering_fragment(F.col("content"), F.col("terms")).alias("fragment"))


def _page(df, *cols):
    return df.select("paper_id", "title", long("publication_year").alias("publication_year"), "total_items", "total_pages")


def _e13(spark, folder):
    p = T.read_papers(spark, folder).drop("text")
    one = L.list_papers(p, 3, status="completed", query=" TH ", sort="title", page=0, size=10)
    two = L.list_papers(p, 5, sort="year", page=1, size=15)
    three = L.list_papers(p, 1, reading_status="read", sort="updated", size=500)
    return _page(one).unionByName(_page(two)).unionByName(_page(three))


def _e14(spark, folder):
    return L.papers_by_tag(T.read_papers(spark, folder).drop("text"), "fr").select("paper_id", "user_id", "title")


def _e15(spark, folder):
    a = T.read_analyses(spark, folder)
    one = L.analysis_history(a, 41, page=0, size=20)
    two = L.analysis_history(a, 78, analysis_type="qa", project_id="p1")
    return one.unionByName(two).select("analysis_id", "user_id", "analysis_type", "input_query")


def _e16(spark, folder):
    return L.distinct_tags(T.read_papers(spark, folder))


def _e17(spark, folder):
    enc = R.encode_hashed(T.read_text_chunks(spark, folder).select("chunk_id", "content"))
    return enc.select("chunk_id", long(F.size("embedding")).alias("dim"),
                      F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("norm2"))


def _e18(spark, folder):
    w = T.read_works(spark, folder).select(
        F.concat(F.lit("idea-"), "lang").alias("query_id"), "external_id", "title")
    h = raw_hits(spark, folder).select(
        F.concat(F.lit("idea-"), F.col("query_id").cast("string")).alias("query_id"), "chunk_id", "paper_title", "similarity")
    return R.novelty_candidates(h, w).withColumn("similarity", F.round("similarity", 4))


_STOP = "[" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + "]"


def _stem(word):
    """The stem of a word in DuckDB, written out."""
    out = word
    for ending, instead in (("^(.{2,})ies$", "\\1y"), ("^(.+(?:ss|x|ch|sh))es$", "\\1"), ("^(.{2,}[^su])s$", "\\1"),
                            ("^(.*[aeiouy].+)(?:ing|ed|ly)$", "\\1"), ("^(.*)(?:(b)b|(d)d|(g)g|(m)m|(n)n|(p)p|(r)r|(t)t)$",
                             "\\1\\2\\3\\4\\5\\6\\7\\8\\9"), ("^(.{3,})e$", "\\1")):
        out = f"regexp_replace({out}, '{ending}', '{instead}')"
    return out


def _stems(text):
    return (f"list_transform(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), "
            f"lambda t: NOT list_contains({_STOP}, t)), lambda t: {_stem('t')})")


KEYWORD = {
    "toks": f"SELECT doc_id, doc_id % 8 AS user_id, source, text, {_stems('text')} AS all_terms FROM documents",
    "asked": f"""SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '\\p{{L}}+'),
                lambda w, i: CASE WHEN i % 2 = 1 AND regexp_matches(w, '^.{{2,}}[ntrdhgl]$')
                                       AND NOT list_contains({_STOP}, lower(w)) THEN w || 's' ELSE w END), ' ') AS text FROM benchmark""",
    "asks": f"""SELECT item_id * 10 + u AS query_id, u AS user_id, list_sort(list_distinct({_stems('text')})) AS terms,
                CASE WHEN item_id % 4 = 0 THEN 'src3' END AS want_project
                FROM asked, range(8) r(u)""",
    "dfs": """SELECT user_id, t AS term, count(*) AS df
              FROM (SELECT user_id, unnest(list_distinct(all_terms)) AS t FROM toks) GROUP BY ALL""",
    "kw": """
        SELECT query_id, chunk_id, text, terms, text_rank,
               row_number() OVER (PARTITION BY query_id ORDER BY text_rank DESC, chunk_id) AS rank
        FROM (SELECT query_id, doc_id AS chunk_id, any_value(text) AS text, any_value(terms) AS terms,
                     round(sum((1 + ln(tf)) * ln(1 + n / df)), 6) AS text_rank
              FROM (SELECT a.query_id, d.doc_id, d.text, a.terms, a.user_id, unnest(a.terms) AS term,
                           unnest(list_transform(a.terms, lambda t: len(list_filter(d.all_terms, lambda x: x = t)))) AS tf
                    FROM asks a JOIN toks d ON a.user_id = d.user_id AND list_has_all(d.all_terms, a.terms)
                      AND (a.want_project IS NULL OR a.want_project = d.source)) m
              JOIN dfs ON dfs.user_id = m.user_id AND dfs.term = m.term
              JOIN (SELECT user_id, count(*) AS n FROM toks GROUP BY user_id) c ON c.user_id = m.user_id
              GROUP BY query_id, doc_id)
        QUALIFY rank <= 20""",
}

QUERIES = {
    "e1_cosine_similarity": (_e1, sql("""
        SELECT c.chunk_id, round(list_cosine_similarity(c.embedding, f.embedding), 4) AS similarity
        FROM vec_chunks c JOIN vec_chunks f ON c.paper_id = f.paper_id AND f.chunk_index = 0""")),
    "e2_vector_topk": (_e2, sql("""
        SELECT query_id, rank, chunk_id, s.paper_id, section_type, chunk_index, round(similarity, 4) AS similarity,
               round(similarity, 4) AS score, p.title AS paper_title, p.publication_year
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM scored) s
        JOIN papers p ON p.paper_id = s.paper_id WHERE rank <= 8""")),
    "e3_section_boost": (_e3, sql("""
        SELECT query_id, rank, chunk_id, paper_id, section_type, chunk_index, round(similarity, 4) AS similarity,
               round(score, 4) AS score FROM hits""")),
    "e4_filtered_topk": (_e4, sql("""
        SELECT query_id, rank, chunk_id, paper_id, section_type, chunk_index, round(similarity, 4) AS similarity,
               round(score, 4) AS score
        FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
              FROM scored s JOIN papers p ON p.paper_id = s.paper_id
              WHERE (query_id % 100 % 2 <> 0 OR list_contains(p.tags, 'en'))
                AND (query_id % 100 % 5 <> 1 OR p.project_id = 'src3')
                AND (query_id % 100 % 5 <> 3 OR p.publication_year = 2000 + s.user_id)
                AND (query_id % 100 <> 9 OR p.paper_id = s.user_id + 16))
        WHERE rank <= 8""")),
    "e5_corpus_size": (_e5, sql("""
        SELECT 'u' || user_id AS scope_id, count(DISTINCT CASE WHEN processing_status = 'completed' THEN paper_id END) AS corpus_size
        FROM papers GROUP BY user_id
        UNION ALL SELECT 'p-' || user_id || '-' || project_id, count(DISTINCT CASE WHEN processing_status = 'completed' THEN paper_id END)
        FROM papers GROUP BY user_id, project_id
        UNION ALL SELECT 'd-' || paper_id, (processing_status = 'completed')::BIGINT FROM papers""")),
    "e6_relevance_floor": (_e6, sql("""
        SELECT q.query_id, count(h.chunk_id) AS n_hits, round(max(similarity), 4) AS best_similarity,
               coalesce(max(similarity) >= 0.5, false) AS sufficient
        FROM questions q LEFT JOIN hits h ON q.query_id = h.query_id GROUP BY q.query_id""")),
    "e7_reload_owned": (_e7, sql("""
        SELECT c.paper_id AS request_id,
               row_number() OVER (PARTITION BY c.paper_id ORDER BY title NULLS LAST, chunk_index, chunk_id) AS position,
               chunk_id, title AS paper_title
        FROM text_chunks c JOIN papers p ON p.paper_id = c.paper_id""")),
    "e8_keyword_search": (_e8, sql("SELECT query_id, rank, chunk_id, round(text_rank, 4) AS text_rank FROM kw", **KEYWORD)),
    "e9_snippet": (_e9, sql("""
        SELECT query_id, chunk_id, array_to_string(w[s : s + 39], ' ') AS snippet
        FROM (SELECT *, greatest(1, least(list_position(list_transform(w, lambda x:
                     list_contains(terms, """ + _stem("regexp_replace(lower(x), '[^\\p{L}\\p{N}]', '', 'g')") + """)), true) - 5, len(w) - 39)) AS s
              FROM (SELECT *, regexp_split_to_array(trim(text, chr(10) || ' '), '\\s+') AS w FROM kw))""", **KEYWORD)),
    "e9_covering_fragment": (_e9_fragment, sql("""
        WITH spots AS (
            SELECT query_id, chunk_id, i, t FROM (
              SELECT query_id, chunk_id, terms, unnest(range(1, len(w) + 1)) AS i, unnest(list_transform(w, lambda x: """
        + _stem("regexp_replace(lower(x), '[^\\p{L}\\p{N}]', '', 'g')") + """)) AS t FROM hit_words) WHERE list_contains(terms, t)),
        met AS (SELECT a.query_id, a.chunk_id, a.i AS start, b.t, min(b.i) AS i
                FROM (SELECT DISTINCT query_id, chunk_id, i FROM spots) a
                JOIN spots b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.i BETWEEN a.i AND a.i + 39 GROUP BY ALL),
        core AS (SELECT query_id, chunk_id, start, max(i) - start + 1 AS n, count(*) AS held FROM met GROUP BY query_id, chunk_id, start
                 QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY held DESC, n, start) = 1)
        SELECT h.query_id, h.chunk_id, array_to_string(w[b : b + total - 1], ' ') AS fragment
        FROM (SELECT h.query_id, h.chunk_id, w, greatest(n, 15) AS total,
                     greatest(1, least(start - (greatest(n, 15) - n) // 2, len(w) - greatest(n, 15) + 1)) AS b
              FROM hit_words h JOIN core c ON c.query_id = h.query_id AND c.chunk_id = h.chunk_id) h""", **KEYWORD,
        hit_words="SELECT *, regexp_split_to_array(trim(text, chr(10) || ' '), '\\s+') AS w FROM kw")),
    "e10_retrieval_text": (_e10, sql("""
        SELECT paper_id, CASE WHEN t = '' THEN 'summary of this paper' ELSE left(t, 1500) END AS query_text
        FROM (SELECT paper_id, trim(CASE WHEN paper_id % 6 <> 0 THEN title ELSE '' END || ' ' ||
                     CASE WHEN paper_id % 3 <> 0 THEN text ELSE '' END) AS t FROM papers)""")),
    "e11_retrieval_plan": (_e11, sql("""
        SELECT analysis_id AS request_id,
               CASE analysis_type WHEN 'concepts' THEN 'keyword_extraction' ELSE analysis_type END AS task,
               CAST(CASE analysis_type WHEN 'summary' THEN 24 WHEN 'concepts' THEN 24 WHEN 'comparison' THEN 12
                    WHEN 'qa' THEN CASE WHEN analysis_id % 3 <> 0 THEN least(greatest(paper_id % 30, 1), 20) ELSE 8 END
                    ELSE 30 END AS BIGINT) AS top_k
        FROM analyses""")),
    "e12_evidence_gate": (_e12, sql("""
        SELECT q.query_id, q.task, count(s.chunk_id) AS n_hits,
               CASE WHEN count(s.chunk_id) = 0 THEN 'EMPTY'
                    WHEN q.task IN ('comparison', 'novelty') OR (q.task = 'qa' AND q.query_id % 2 = 0) THEN 'OK'
                    WHEN max(similarity) >= 0.5 THEN 'OK' ELSE 'IRRELEVANT' END AS gate
        FROM questions q LEFT JOIN (SELECT * FROM scored WHERE query_id % 3 <> 0
             QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 8) s
          ON q.query_id = s.query_id GROUP BY q.query_id, q.task""")),
    "e13_library_page": (_e13, sql("""
        SELECT paper_id, title, publication_year, total_items, total_pages FROM (
          (SELECT *, count(*) OVER () AS total_items, ceil(count(*) OVER () / 10)::BIGINT AS total_pages FROM papers
           WHERE user_id = 3 AND processing_status = 'completed' AND contains(lower(title), 'th')
           ORDER BY title NULLS LAST, paper_id LIMIT 10)
          UNION ALL BY NAME
          (SELECT *, count(*) OVER () AS total_items, ceil(count(*) OVER () / 15)::BIGINT AS total_pages FROM papers
           WHERE user_id = 5 ORDER BY publication_year DESC NULLS FIRST, paper_id LIMIT 15 OFFSET 15)
          UNION ALL BY NAME
          (SELECT *, count(*) OVER () AS total_items, ceil(count(*) OVER () / 100)::BIGINT AS total_pages FROM papers
           WHERE user_id = 1 AND reading_status = 'read' ORDER BY updated_at DESC NULLS FIRST, paper_id LIMIT 100))""")),
    "e14_papers_by_tag": (_e14, sql("SELECT paper_id, user_id, title FROM papers WHERE list_contains(tags, 'fr')")),
    "e15_analysis_history": (_e15, sql("""
        (SELECT analysis_id, user_id, analysis_type, input_query FROM analyses WHERE user_id = 41
         ORDER BY created_at DESC, analysis_id LIMIT 20)
        UNION ALL
        (SELECT analysis_id, user_id, analysis_type, input_query FROM analyses
         WHERE user_id = 78 AND analysis_type = 'qa' AND project_id = 'p1' ORDER BY created_at DESC, analysis_id LIMIT 20)""")),
    "e16_distinct_tags": (_e16, sql("SELECT DISTINCT user_id, unnest(tags) AS tag FROM papers")),
    "e17_encode": (_e17, sql("""
        SELECT chunk_id, 384::BIGINT AS dim, CASE WHEN regexp_matches(content, '\\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm2
        FROM text_chunks""")),
    "e18_novelty_candidates": (_e18, sql("""
        SELECT 'idea-' || query_id AS query_id, 'library' AS origin, chunk_id::VARCHAR AS evidence_id,
               paper_title AS title, round(similarity, 4) AS similarity FROM hits
        UNION ALL SELECT 'idea-' || lang, 'external', 'ext:' || external_id, title, NULL FROM works""")),
}
# The same rows, found another way.
QUERIES["e4_stored_cells"] = (_e4_cells, QUERIES["e4_filtered_topk"][1])
QUERIES["e8_stored_index"] = (_e8_index, QUERIES["e8_keyword_search"][1])
