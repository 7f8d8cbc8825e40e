"""Group B: cleaning and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import long
from ..operators import cleaning as C
from ..operators import sections as S
from ..sources import tables as T
from .duck import sql

HEADINGS = (
    "Abstract", "1 Introduction", "2. Related Work", "III. METHODOLOGY", "4.1 Results", "Discussion",
    "Limitations:", "Conclusions and Future Work", "Conclusion", "References", "Methods", "3.2 Approach",
)


def _docs(spark, folder):
    return T.read_documents(spark, folder, ["doc_id", "text", "source"])


def headed(spark, folder):
    """Documents with a heading before every fourth line from the third on."""
    pick = lambda i: T.pick(HEADINGS, (F.col("doc_id") + F.floor(i / 4)) % 12)
    lines = F.transform(
        F.split("text", "\n"), lambda l, i: F.when(i % 4 == 2, F.concat(pick(i), F.lit("\n"), l)).otherwise(l))
    return _docs(spark, folder).select(F.col("doc_id").alias("paper_id"), F.array_join(lines, "\n").alias("text"))


def journal_pages(spark, folder):
    """Documents of one source are the pages of one journal volume, with furniture lines."""
    head = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("Journal of "), "source", F.lit("\n"))).otherwise("")
    return _docs(spark, folder).select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"),
        F.concat(head, F.col("text"), F.lit("\n- "), F.col("doc_id") % 400, F.lit(" -\nwww.example.org/"), F.col("doc_id")).alias("text"))


def _dirty(text, *pairs):
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _b1(spark, folder):
    dirty = _dirty(F.col("text"), (", ", ",\x07 "), (". ", ".\x9f \x1f"), ("an", "a\x7fn"), ("\n", "\t\n"))
    return _docs(spark, folder).select("doc_id", C.strip_control(dirty).alias("text"))


def _b2(spark, folder):
    dirty = _dirty(F.col("text"), ("fi", "ﬁ"), ("ff", "ﬀ"), ("st", "ﬆ"), ("A", "Ａ"))
    return _docs(spark, folder).select("doc_id", C.nfkc(dirty).alias("text"))


def _b3(spark, folder):
    dirty = _dirty(F.col("text"), ("tion ", "ti-\non "), ("é ", "é- \n é"), ("er", "e­r"))
    return _docs(spark, folder).select("doc_id", C.join_hyphens(dirty).alias("text"))


def _b4(spark, folder):
    dirty = _dirty(F.col("text"), (" th", "   th"), (". ", ".\t  "), ("\n", " \t\n\n\n\n"))
    return _docs(spark, folder).select("doc_id", C.tidy_space(F.concat(F.lit("\n "), dirty, F.lit(" \n"))).alias("text"))


def _b5(spark, folder):
    return C.strip_running_lines(journal_pages(spark, folder)).select("doc_id", "page_no", "text")


def _b6(spark, folder):
    lines = journal_pages(spark, folder).select("page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(C.is_furniture(F.col("line"))).select("page_no", long("line_no").alias("line_no"), "line")


def _b7(spark, folder):
    pages = T.read_text_chunks(spark, folder).select(
        F.col("paper_id").alias("doc_id"), F.col("chunk_index").alias("page_no"), F.col("content").alias("text"))
    out = C.assemble_documents(pages, max_pages=60, max_chars=15_000, unicode_form=False, share=2.0)
    return out.select("doc_id", "page_count", "raw_chars", "reject_code", long(F.length("text")).alias("n_chars"))


def _b8(spark, folder):
    lines = headed(spark, folder).select("paper_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = lines.withColumn("label", S.heading_label(F.col("line"))).filter("label IS NOT NULL")
    return found.select("paper_id", long("line_no").alias("line_no"), "label")


def _sections(df):
    return df.select("paper_id", long("order_index").alias("order_index"), "section_type", "heading", "content")


def _b9(spark, folder):
    return _sections(S.detect_sections(headed(spark, folder), merge=False))


def _b10(spark, folder):
    return _sections(S.detect_sections(headed(spark, folder)))


def _b11(spark, folder):
    docs = _docs(spark, folder).select(
        F.col("doc_id").alias("paper_id"), "text", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("hint"))
    return _sections(S.detect_sections(docs, abstract_hint="hint"))


def _b12(spark, folder):
    return S.abstracts(S.detect_sections(headed(spark, folder)))


def _b13(spark, folder):
    rep = S.section_report(S.detect_sections(headed(spark, folder)))
    return rep.select("paper_id", long("order_index").alias("order_index"), "section_type", "heading", long("characters").alias("characters"))


def _label(x: str) -> str:
    cand = (f"regexp_replace(regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '{S.NUMBER_PREFIX}', '', 'i'),"
            " '^[ :–—-]+|[ :–—-]+$', '', 'g')")
    cases = " ".join(f"WHEN regexp_matches(c, '{p}', 'i') THEN '{n}'" for n, p in S.HEADING_PATTERNS)
    return f"""(SELECT CASE WHEN {x} IS NULL OR trim({x}) = '' OR len(trim({x})) > 90 OR c = ''
        OR len(regexp_split_to_array(c, '\\s+')) > 8 OR regexp_matches(c, '[.!?,;]$') THEN NULL {cases} END
        FROM (SELECT {cand} AS c))"""


_HEADS = "[" + ", ".join(f"'{h}'" for h in HEADINGS) + "]"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
SECTION_VIEWS = {
    "headed": f"""
        SELECT doc_id AS paper_id, string_agg(CASE WHEN i % 4 = 2 THEN {_HEADS}[(doc_id + i // 4) % 12 + 1] || chr(10) || l ELSE l END, chr(10) ORDER BY i) AS text
        FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS l, unnest(range(len(str_split(text, chr(10))))) AS i FROM documents)
        GROUP BY doc_id""",
    "hlines": """SELECT paper_id, unnest(str_split(text, chr(10))) AS line, unnest(range(len(str_split(text, chr(10))))) AS i FROM headed""",
    "labelled": f"SELECT paper_id, i, line, {_label('line')} AS label FROM hlines",
    "islands": "SELECT *, sum((label IS NOT NULL)::INT) OVER (PARTITION BY paper_id ORDER BY i) AS grp FROM labelled",
    "bodies": f"""
        SELECT paper_id, grp, max(label) AS label, max(CASE WHEN label IS NOT NULL THEN {_STRIP.format('line')} END) AS heading,
               coalesce({_STRIP.format("string_agg(line, chr(10) ORDER BY i) FILTER (WHERE label IS NULL)")}, '') AS body
        FROM islands GROUP BY paper_id, grp""",
    "cuts": """
        SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY grp) - 1 AS order_index,
               CASE WHEN grp > 0 THEN label WHEN contains(lower(left(body, 400)), 'abstract') OR len(body) > 300 THEN 'abstract' ELSE 'other' END AS section_type,
               CASE WHEN grp > 0 THEN heading ELSE 'Front matter' END AS heading, body AS content
        FROM bodies WHERE body <> ''
          AND paper_id IN (SELECT paper_id FROM labelled WHERE label IS NOT NULL)""",
    "whole": """
        SELECT paper_id, 0::BIGINT AS order_index, 'other' AS section_type, 'Document' AS heading, text AS content
        FROM headed WHERE paper_id NOT IN (SELECT paper_id FROM cuts)""",
    "joined": """
        SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY min(order_index)) - 1 AS order_index,
               any_value(section_type) AS section_type, min_by(heading, order_index) AS heading,
               string_agg(CASE WHEN start THEN content ELSE heading || chr(10) || content END, chr(10) || chr(10) ORDER BY order_index) AS content
        FROM (SELECT *, sum(start::INT) OVER (PARTITION BY paper_id ORDER BY order_index) AS isl
              FROM (SELECT *, coalesce(section_type <> lag(section_type) OVER w OR section_type = 'other', true) AS start
                    FROM cuts WINDOW w AS (PARTITION BY paper_id ORDER BY order_index)))
        GROUP BY paper_id, isl""",
    "secs": "SELECT * FROM joined UNION ALL SELECT * FROM whole",
}
_PAGES = {"jpages": """
    SELECT source AS doc_id, doc_id AS page_no, CASE WHEN doc_id % 3 <> 0 THEN 'Journal of ' || source || chr(10) ELSE '' END
           || text || chr(10) || '- ' || doc_id % 400 || ' -' || chr(10) || 'www.example.org/' || doc_id AS text FROM documents"""}


def _furniture(x: str) -> str:
    number, url = (p.replace("(?iU)", "") for p in (C.PAGE_NUMBER, C.URL_ONLY))
    return f"(regexp_matches({x}, '{number}', 'i') OR regexp_matches({x}, '{url}', 'i'))"


def _q(text: str, *pairs) -> str:
    for old, new in pairs:
        text = f"replace({text}, {old}, {new})"
    return text


QUERIES = {
    "b1_strip_control": (_b1, f"""SELECT doc_id, regexp_replace({_q('text', ("', '", "',' || chr(7) || ' '"), ("'. '", "'.' || chr(159) || ' ' || chr(31)"), ("'an'", "'a' || chr(127) || 'n'"), ("chr(10)", "chr(9) || chr(10)"))},
        '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', '', 'g') AS text FROM documents"""),
    "b2_unicode_form": (_b2, "SELECT doc_id, text FROM documents"),
    "b3_join_hyphens": (_b3, f"""SELECT doc_id, replace(regexp_replace({_q('text', ("'tion '", "'ti-' || chr(10) || 'on '"), ("'é '", "'é- ' || chr(10) || ' é'"), ("'er'", "'e' || chr(173) || 'r'"))},
        '([\\p{{L}}\\p{{N}}_])[-\\x{{00ad}}]\\s*\\n\\s*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), chr(173), '') AS text FROM documents"""),
    "b4_tidy_space": (_b4, f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        chr(10) || ' ' || {_q('text', ("' th'", "'   th'"), ("'. '", "'.' || chr(9) || '  '"), ("chr(10)", "' ' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10)"))} || ' ' || chr(10),
        '[ \\t]+\\n', chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents"""),
    "b5_running_headers": (_b5, sql(f"""
        SELECT l.doc_id, l.page_no, coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE r.line IS NULL AND NOT {_furniture('l.line')}), '') AS text
        FROM jlines l LEFT JOIN rep r ON l.doc_id = r.doc_id AND trim(l.line) = r.line GROUP BY l.doc_id, l.page_no""", **_PAGES,
        jlines="SELECT doc_id, page_no, unnest(str_split(text, chr(10))) AS line, unnest(range(len(str_split(text, chr(10))))) AS i FROM jpages",
        ends="SELECT doc_id, page_no, trim(min_by(line, i)) AS f, trim(max_by(line, i)) AS l FROM jlines WHERE trim(line) <> '' GROUP BY doc_id, page_no",
        rep="""SELECT DISTINCT doc_id, line FROM (SELECT doc_id, 'f' AS s, f AS line FROM ends UNION ALL SELECT doc_id, 'l', l FROM ends)
               JOIN (SELECT doc_id, count(*) AS n FROM jpages GROUP BY doc_id) t USING (doc_id)
               GROUP BY doc_id, s, line, n HAVING count(*) >= greatest(3, n // 2)""")),
    "b6_furniture_lines": (_b6, sql(f"""
        SELECT page_no, line_no, line FROM (SELECT page_no, unnest(str_split(text, chr(10))) AS line, unnest(range(len(str_split(text, chr(10))))) AS line_no FROM jpages)
        WHERE {_furniture('line')}""", **_PAGES)),
    "b7_document_gates": (_b7, sql("""
        SELECT doc_id, page_count, raw_chars, CASE WHEN page_count > 60 OR raw_chars > 15000 THEN 'PDF_TOO_COMPLEX'
                    WHEN n < 200 THEN 'NO_EXTRACTABLE_TEXT' END AS reject_code,
               CASE WHEN page_count <= 60 AND raw_chars <= 15000 THEN n END AS n_chars
        FROM (SELECT paper_id AS doc_id, count(*) AS page_count, sum(len(content))::BIGINT AS raw_chars,
                     len(regexp_replace(regexp_replace(regexp_replace(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index), '[ \\t]+\\n', chr(10), 'g'), '[ \\t]{2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS n
              FROM text_chunks GROUP BY paper_id)""")),
    "b8_heading_labels": (_b8, sql("SELECT paper_id, i AS line_no, label FROM labelled WHERE label IS NOT NULL", **SECTION_VIEWS)),
    "b9_section_split": (_b9, sql("SELECT * FROM cuts UNION ALL SELECT * FROM whole", **SECTION_VIEWS)),
    "b10_section_merge": (_b10, sql("SELECT * FROM secs", **SECTION_VIEWS)),
    "b11_section_fallback": (_b11, sql("""
        SELECT * FROM secs WHERE paper_id NOT IN (SELECT paper_id FROM whole)
        UNION ALL SELECT paper_id, CASE WHEN paper_id % 2 = 0 THEN 1 ELSE 0 END, section_type, heading, content FROM whole
        UNION ALL SELECT doc_id, 0, 'abstract', 'Abstract', source FROM documents
                  WHERE doc_id % 2 = 0 AND doc_id IN (SELECT paper_id FROM whole)""",
        **{**SECTION_VIEWS, "headed": "SELECT doc_id AS paper_id, text FROM documents"})),
    "b12_abstracts": (_b12, sql("""
        SELECT paper_id, CASE WHEN len(a) >= 80 THEN left(a, 6000) END AS abstract
        FROM (SELECT paper_id, trim(regexp_replace(regexp_replace(min_by(content, order_index), '^\\s*abstract[\\s:.-]*', '', 'i'), '\\s+', ' ', 'g')) AS a
              FROM secs WHERE section_type = 'abstract' GROUP BY paper_id)""", **SECTION_VIEWS)),
    "b13_section_report": (_b13, sql("SELECT paper_id, order_index, section_type, heading, len(content) AS characters FROM secs", **SECTION_VIEWS)),
}
