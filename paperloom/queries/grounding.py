"""Group G: replies and their checks. Replies are made from the documents' own passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import long
from ..operators import evidence as E
from ..operators import grounding as G
from ..operators import replies as R
from ..sources import tables as T
from .duck import sql
from .evidence import INJECTED, screened, unscreened


def _d():
    return F.col("paper_id")


def _r():
    return F.col("request_id")


def _first(spark, folder):
    """First passage of each paper: id and plain words of its text."""
    c = T.read_text_chunks(spark, folder)
    f = c.groupBy("paper_id").agg(F.min_by(F.struct("chunk_id", "content"), "chunk_index").alias("f"))
    plain = F.regexp_replace("f.content", r"[^\p{L}\p{N} ]", "")
    return f.select("paper_id", F.col("f.chunk_id").alias("c0"), plain.alias("q0"))


def _cat(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def qa_replies(spark, folder):
    claims = F.array_compact(F.array(
        F.when(_d() % 5 != 4, _cat('{"statement":" real ', _d().cast("string"), '","chunk_id":"', F.col("c0"), '","section":"results"}')),
        F.when(_d() % 3 != 0, _cat('{"statement":"foreign","chunk_id":"', (_d() + 1).cast("string"), ':0"}')),
        F.when(_d() % 2 == 0, F.lit('{"statement":"invented","chunk_id":"x-9"}')),
        F.when(_d() % 4 == 0, F.lit('{"statement":"uncited","chunk_id":null}')),
        F.when(_d() % 7 == 5, F.lit('{"statement":5}'))))
    confidence = F.when(_d() % 7 == 3, "sure").otherwise("high")
    j = _cat('{"answer":"a of ', _d().cast("string"), '","claims":[', F.array_join(claims, ","), '],"confidence":"', confidence, '","limitations":"  l  ","ride":1}')
    k = _d() % 6
    text = (
        F.when(k == 0, j).when(k == 1, _cat("```json\n", j, "\n```")).when(k == 2, _cat("Here it is: ", j, " Hope {it} helps"))
        .when(k == 3, F.substring(j, F.lit(1), F.length(j) - 5)).when(k == 4, _cat("```\n", j, "\n``` bye")).otherwise(_cat("[", j, "]")))
    # A third of the wrapped replies keeps its brace in the prose, which spoils it.
    text = F.when((k == 2) & (_d() % 4 != 0), _cat("Here it is: ", j, " Hope it helps")).otherwise(text)
    return _first(spark, folder).select(_d().alias("request_id"), text.alias("text"))


REPLIES = {
    **INJECTED,
    "firsts": """SELECT paper_id, min_by(chunk_id, chunk_index) AS c0, regexp_replace(min_by(content, chunk_index), '[^\\p{L}\\p{N} ]', '', 'g') AS q0
                 FROM text_chunks GROUP BY paper_id""",
    "js": """
        SELECT paper_id AS request_id, '{"answer":"a of ' || paper_id || '","claims":[' || array_to_string(list_filter([
            CASE WHEN paper_id % 5 <> 4 THEN '{"statement":" real ' || paper_id || '","chunk_id":"' || c0 || '","section":"results"}' END,
            CASE WHEN paper_id % 3 <> 0 THEN '{"statement":"foreign","chunk_id":"' || (paper_id + 1) || ':0"}' END,
            CASE WHEN paper_id % 2 = 0 THEN '{"statement":"invented","chunk_id":"x-9"}' END,
            CASE WHEN paper_id % 4 = 0 THEN '{"statement":"uncited","chunk_id":null}' END,
            CASE WHEN paper_id % 7 = 5 THEN '{"statement":5}' END], lambda x: x IS NOT NULL), ',')
          || '],"confidence":"' || CASE WHEN paper_id % 7 = 3 THEN 'sure' ELSE 'high' END || '","limitations":"  l  ","ride":1}' AS j,
          paper_id % 6 IN (0, 1, 4) OR (paper_id % 6 = 2 AND paper_id % 4 <> 0) AS readable
        FROM firsts""",
    "good": "SELECT * FROM js WHERE readable AND request_id % 7 NOT IN (3, 5)",
    "real": """SELECT g.request_id, NOT f.suspicious AS citable FROM good g JOIN firsts t ON t.paper_id = g.request_id JOIN flagged f ON f.chunk_id = t.c0""",
}


def _g1(spark, folder):
    return qa_replies(spark, folder).select("request_id", R.extract_json(F.col("text")).alias("json"))


def _qa(spark, folder):
    return R.parse_replies(qa_replies(spark, folder), "qa")


def _g2(spark, folder):
    r = F.col("result")
    return _qa(spark, folder).select(
        "request_id", "valid", "reject_reason", r["answer"].alias("answer"), r["confidence"].alias("confidence"), r["limitations"].alias("limitations"),
        r["evidence_sufficient"].alias("evidence_sufficient"), long(F.when(F.col("valid"), F.size(r["claims"]))).alias("n_claims"))


def _g3(spark, folder):
    good = _qa(spark, folder).filter("valid")
    claims = good.select("request_id", F.posexplode("result.claims").alias("pos", "claim"))
    kept = G.drop_unsupported_claims(claims, E.citable(screened(spark, folder)))
    return kept.select("request_id", "claim.statement", "claim.chunk_id")


def _g4(spark, folder):
    g = G.ground_answers(_qa(spark, folder), screened(spark, folder))
    return g.select("request_id", "answer", long(F.size("claims")).alias("n_claims"), "evidence_sufficient", "confidence", "limitations")


def _g5(spark, folder):
    c = screened(spark, folder).join(_first(spark, folder), "paper_id")
    quote = F.when(F.col("chunk_index") % 3 == 0, F.lit("too, short: quote")).otherwise(F.upper(F.concat_ws("--", F.substring("q0", 1, 30), F.substring("q0", 31, 30))))
    return c.select("chunk_id", G.quote_supported(quote, F.col("content")).alias("supported"))


def gap_replies(spark, folder):
    d = _d().cast("string")
    ev = lambda chunk, quote: F.struct(chunk.alias("chunk_id"), F.lit("wrong").alias("paper_id"), F.lit("x").alias("section"), quote.alias("quote"))
    q = F.concat(F.substring("q0", 1, 40), F.lit("!"))
    absent = F.lit("this long quotation does not appear anywhere at all")
    gap = lambda s, conf, *evs: F.struct(F.concat(F.lit(s), d).alias("statement"), F.array(*evs).alias("evidence"), conf.alias("confidence"))
    gaps = F.array(
        gap("g0 ", F.lit("medium"), ev(F.col("c0"), absent), ev(F.lit("x-9"), q)),
        gap("g1 ", F.when(_d() % 2 == 0, "high").otherwise("medium"), ev(F.col("c0"), q), ev(F.concat((_d() + 1).cast("string"), F.lit(":0")), q)),
        gap("g2 ", F.lit("low"), ev(F.col("c0"), F.lit("tiny")), ev(F.col("c0"), q)))
    body = F.to_json(F.struct(gaps.alias("gaps"), F.when(_d() % 3 == 0, "own words").otherwise("").alias("limitations")))
    return _first(spark, folder).select(_d().alias("request_id"), (_d() % 20).alias("corpus_size"), body.alias("text"))


def _gaps(spark, folder):
    return G.ground_gaps(R.parse_replies(gap_replies(spark, folder), "research_gap"), unscreened(spark, folder))


def _g6(spark, folder):
    g = _gaps(spark, folder).select("request_id", F.explode("gaps").alias("x"))
    e = g.select("request_id", F.col("x.gap_pos").alias("gap_pos"), F.col("x.g.confidence").alias("confidence"), F.explode("x.evidence").alias("e"))
    return e.select("request_id", long("gap_pos").alias("gap_pos"), long("e.ev_pos").alias("ev_pos"), "confidence", "e.chunk_id", "e.paper_id", "e.paper_title")


def _g7(spark, folder):
    d = _d().cast("string")
    ev = lambda chunk, quote: F.struct(chunk.alias("chunk_id"), F.lit("wrong").alias("paper_id"), quote.alias("quote"))
    q = F.substring("q0", 1, 60)
    body = F.to_json(F.struct(
        F.array(ev(F.col("c0"), q), ev(F.col("c0"), F.lit("this long quotation does not appear anywhere at all")), ev(F.lit("no"), q)).alias("evidence"),
        F.lit("high").alias("confidence"), F.when(_d() % 2 == 0, F.concat(F.lit(" seen "), d, F.lit(" "))).otherwise("").alias("limitations")))
    rep = _first(spark, folder).select(_d().alias("request_id"), (_d() % 30).alias("corpus_size"), (_d() % 3).alias("n_external"), body.alias("text"))
    strength = rep.select("request_id", F.when(_r() % 4 != 0, (_r() % 10) / 10.0).alias("best_similarity"))
    out = G.ground_novelty(R.parse_replies(rep, "novelty"), unscreened(spark, folder), strength)
    return out.select("request_id", long(F.coalesce(F.size("evidence"), F.lit(0))).alias("n_evidence"), F.get("evidence", F.lit(0))["paper_id"].alias("paper_id"), "confidence", "limitations")


def _g8(spark, folder):
    p = T.scan(spark, folder, "part", ["p_partkey", "p_size"])
    k = F.col("p_partkey")
    stated = T.pick(("low", "medium", "high", "unsure"), k % 4)
    best = F.when(k % 3 != 0, (k % 100) / 100.0)
    return p.select("p_partkey", G.bounded_confidence(stated, F.col("p_size") % 25, best).alias("confidence"))


def _g9(spark, folder):
    p = T.scan(spark, folder, "part", ["p_partkey", "p_size", "p_name"])
    own = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return p.select("p_partkey", G.novelty_limitations(own, F.col("p_size"), F.col("p_partkey") % 3).alias("novelty"),
                    G.gap_limitations(own, F.col("p_size")).alias("gap"))


def _g10(spark, folder):
    ev = screened(spark, folder).withColumn("request_id", F.floor(_d() / 4)).select("request_id", "paper_id", "paper_title")
    req = ev.select("request_id").distinct()
    refs = req.filter("request_id % 3 <> 2").select("request_id", F.explode(F.array(F.col("request_id") * 4, F.col("request_id") * 4 + 9)).alias("p")).select(
        "request_id", F.col("p").cast("string").alias("paper_id"), F.concat(F.lit("ref "), "p").alias("title"), F.lit(2020).alias("year"))
    return G.review_references(refs, ev).select("request_id", "paper_id", "title", "origin")


def _g11(spark, folder):
    o = T.scan(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"]).groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda v: F.when(v["l_returnflag"] == "N", " ").otherwise(v["l_returnflag"])).alias("vs"))
    return o.select("l_orderkey", F.array_join(G.pad_values(F.col("vs"), F.lit(5)), "|").alias("cells"))


def _g12(spark, folder):
    rows = T.read_jobs(spark, folder).select(F.col("paper_id").alias("request_id"), F.col("job_id").alias("gap_pos"), T.pick(("low", "medium", "high"), F.col("job_id") % 3).alias("confidence"))
    return G.gap_confidence(rows)


def _g13(spark, folder):
    e = T.read_events(spark, folder)
    pts = lambda df: df.groupBy(F.col("user_id").alias("request_id")).agg(F.array_sort(F.collect_set(F.concat(F.lit(" Point  "), F.col("k") % 40))).alias("points"))
    second = pts(e.filter("event_type = 'click' AND user_id > 20"))
    out = G.second_opinion(pts(e.filter("event_type = 'view'")), second)
    return out.select("request_id", "second_opinion_available", F.array_join(F.array_sort("agreements"), ",").alias("agreements"), F.array_join(F.array_sort("disagreements"), ",").alias("disagreements"))


def _g14(spark, folder):
    c = T.read_concepts(spark, folder)
    kind = F.when(F.col("part_id") % 50 == 0, "thing").otherwise(F.col("concept_type"))
    items = c.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(
        "line_no", "part_id", F.struct(F.concat(F.lit(" "), "concept").alias("concept"), kind.alias("concept_type"), F.round(F.col("confidence") + 0.05, 2).alias("confidence"))))).alias("xs"))
    rep = items.select("paper_id", F.to_json(F.struct(F.col("xs.col3").alias("concepts"))).alias("text"))
    return R.concept_rows(R.parse_replies(rep, "keyword_extraction")).withColumn("confidence", F.round(F.col("confidence").cast("double"), 4))


def _alnum(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_ORD = "CASE {} WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END"
_NAMES = "['low', 'medium', 'high']"
_GAPROWS = {
    **REPLIES,
    "held": f"""
        SELECT t.paper_id AS request_id, n.gap_pos, n.ev_pos, t.c0 AS chunk_id, f.paper_title, n.conf,
               CASE WHEN t.paper_id % 20 < 5 THEN 0 WHEN t.paper_id % 20 < 15 THEN 1 ELSE 2 END AS ceil
        FROM firsts t JOIN flagged f ON f.chunk_id = t.c0,
             LATERAL (VALUES (1, 0, CASE WHEN t.paper_id % 2 = 0 THEN 'high' ELSE 'medium' END, left(t.q0, 40)), (2, 0, 'low', 'tiny'), (2, 1, 'low', left(t.q0, 40))) n(gap_pos, ev_pos, conf, quote)
        WHERE NOT f.suspicious AND (len({_alnum('n.quote')}) < 24 OR contains({_alnum('f.body')}, {_alnum('n.quote')}))""",
}
_NOV = "'Based on ' || {n} || ' paper(s) retrieved from your library' || CASE WHEN {e} > 0 THEN ' and ' || {e} || ' record(s) from academic search' ELSE '' END || '. This is not a proof of novelty: the absence of similar work in this corpus does not mean none exists.'"

QUERIES = {
    "g1_extract_json": (_g1, sql("SELECT request_id, CASE WHEN readable THEN j END AS json FROM js", **REPLIES)),
    "g2_validate_reply": (_g2, sql("""
        SELECT j.request_id, g.request_id IS NOT NULL AS valid,
               CASE WHEN NOT j.readable THEN 'NO_JSON_OBJECT' WHEN j.request_id % 7 = 3 THEN 'INVALID:confidence' WHEN j.request_id % 7 = 5 THEN 'INVALID:claims' END AS reject_reason,
               CASE WHEN g.request_id IS NOT NULL THEN 'a of ' || j.request_id END AS answer, CASE WHEN g.request_id IS NOT NULL THEN 'high' END AS confidence,
               CASE WHEN g.request_id IS NOT NULL THEN 'l' END AS limitations, CASE WHEN g.request_id IS NOT NULL THEN true END AS evidence_sufficient,
               CASE WHEN g.request_id IS NOT NULL THEN ((j.request_id % 5 <> 4)::INT + (j.request_id % 3 <> 0)::INT + (j.request_id % 2 = 0)::INT + (j.request_id % 4 = 0)::INT)::BIGINT END AS n_claims
        FROM js j LEFT JOIN good g ON g.request_id = j.request_id""", **REPLIES)),
    "g3_drop_unsupported": (_g3, sql("""
        SELECT r.request_id, 'real ' || r.request_id AS statement, t.c0 AS chunk_id FROM real r JOIN firsts t ON t.paper_id = r.request_id WHERE citable AND r.request_id % 5 <> 4
        UNION ALL SELECT request_id, 'uncited', NULL FROM good WHERE request_id % 4 = 0""", **REPLIES)),
    "g4_answer_downgrade": (_g4, sql(f"""
        SELECT request_id, CASE WHEN n = 0 AND q > 0 THEN '{G.QUARANTINE_ANSWER}' ELSE 'a of ' || request_id END AS answer, n AS n_claims, n > 0 AS evidence_sufficient,
               CASE WHEN n = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN n = 0 AND q > 0 THEN '{G.QUARANTINE_LIMITS.replace("'", "''")}' ELSE 'l' END AS limitations
        FROM (SELECT r.request_id, ((r.citable AND r.request_id % 5 <> 4)::INT + (r.request_id % 4 = 0)::INT)::BIGINT AS n,
                     (SELECT count(*) FROM flagged f WHERE f.paper_id = r.request_id AND f.suspicious) AS q FROM real r)""", **REPLIES)),
    "g5_quote_check": (_g5, sql(f"""
        SELECT chunk_id, chunk_index % 3 = 0 OR len({_alnum('left(q0, 60)')}) < 24 OR contains({_alnum('body')}, {_alnum('left(q0, 60)')}) AS supported
        FROM inj JOIN firsts t ON t.paper_id = inj.paper_id""", **REPLIES)),
    "g6_gap_evidence": (_g6, sql(f"""
        SELECT request_id, gap_pos, ev_pos, CASE WHEN {_ORD.format('conf')} <= ceil THEN conf ELSE {_NAMES}[ceil + 1] END AS confidence,
               chunk_id, request_id::VARCHAR AS paper_id, coalesce(nullif(paper_title, ''), 'Untitled paper') AS paper_title FROM held""", **_GAPROWS)),
    "g7_novelty_evidence": (_g7, sql(f"""
        SELECT request_id, CASE WHEN ok THEN 1 ELSE 0 END AS n_evidence, CASE WHEN ok THEN request_id::VARCHAR END AS paper_id,
               {_NAMES}[least(CASE WHEN n < 5 THEN 0 WHEN n < 15 THEN 1 ELSE 2 END, CASE WHEN b < 0.5 THEN 0 WHEN b < 0.65 THEN 1 ELSE 2 END) + 1] AS confidence,
               CASE WHEN request_id % 2 = 0 THEN 'seen ' || request_id || ' ' ELSE '' END || {_NOV.format(n='n', e='request_id % 3')} AS limitations
        FROM (SELECT t.paper_id AS request_id, t.paper_id % 30 AS n, CASE WHEN t.paper_id % 4 <> 0 THEN t.paper_id % 10 / 10.0 END AS b,
                     NOT f.suspicious AND (len({_alnum('left(q0, 60)')}) < 24 OR contains({_alnum('body')}, {_alnum('left(q0, 60)')})) AS ok
              FROM firsts t JOIN flagged f ON f.chunk_id = t.c0)""", **REPLIES)),
    "g8_confidence_ceiling": (_g8, f"""
        SELECT p_partkey, CASE WHEN {_ORD.format('s')} <= c THEN s ELSE {_NAMES}[c + 1] END AS confidence
        FROM (SELECT p_partkey, ['low', 'medium', 'high', 'unsure'][p_partkey % 4 + 1] AS s,
                least(CASE WHEN p_size % 25 < 5 THEN 0 WHEN p_size % 25 < 15 THEN 1 ELSE 2 END,
                      CASE WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 100 / 100.0 < 0.5 THEN 0 WHEN p_partkey % 100 / 100.0 < 0.65 THEN 1 ELSE 2 END) AS c FROM part)"""),
    "g9_limitations": (_g9, f"""
        SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' ELSE '' END || {_NOV.format(n='p_size', e='p_partkey % 3')} AS novelty,
               CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_name || ' ' ELSE 'Based only on the ' || p_size || ' paper(s) indexed in this project.' END AS gap FROM part"""),
    "g10_review_references": (_g10, sql("""
        SELECT request_id, (request_id * 4)::VARCHAR AS paper_id, 'ref ' || (request_id * 4) AS title, 'cited' AS origin
        FROM (SELECT DISTINCT paper_id // 4 AS request_id FROM inj) WHERE request_id % 3 <> 2 AND request_id * 4 IN (SELECT paper_id FROM inj)
        UNION ALL SELECT DISTINCT paper_id // 4, paper_id::VARCHAR, coalesce(nullif(paper_title, ''), 'Untitled paper'), 'contributed' FROM inj
        WHERE paper_id // 4 % 3 = 2 OR paper_id // 4 * 4 NOT IN (SELECT paper_id FROM inj)""", **INJECTED)),
    "g11_comparison_padding": (_g11, """
        SELECT l_orderkey, string_agg(v, '|' ORDER BY i) AS cells FROM (
          SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS i, CASE WHEN l_returnflag = 'N' THEN 'Not reported' ELSE l_returnflag END AS v FROM lineitem
          UNION ALL SELECT l_orderkey, 1000 + r, 'Not reported' FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), range(5) t(r) WHERE n + r < 5)
        GROUP BY l_orderkey"""),
    "g12_gap_confidence": (_g12, sql("""
        SELECT paper_id AS request_id, ['low', 'medium', 'high'][min(job_id) % 3 + 1] AS confidence FROM jobs GROUP BY paper_id""")),
    "g13_second_opinion": (_g13, sql("""
        WITH a AS (SELECT user_id AS request_id, list_sort(list(DISTINCT 'point ' || k % 40)) AS p FROM ev WHERE event_type = 'view' GROUP BY 1),
             b AS (SELECT user_id AS request_id, list_sort(list(DISTINCT 'point ' || k % 40)) AS p FROM ev WHERE event_type = 'click' AND user_id > 20 GROUP BY 1)
        SELECT a.request_id, b.p IS NOT NULL AS second_opinion_available,
               CASE WHEN b.p IS NULL THEN '' ELSE array_to_string(list_filter(a.p, lambda x: list_contains(b.p, x)), ',') END AS agreements,
               CASE WHEN b.p IS NULL THEN '' ELSE array_to_string(list_sort(list_concat(list_filter(a.p, lambda x: NOT list_contains(b.p, x)), list_filter(b.p, lambda x: NOT list_contains(a.p, x)))), ',') END AS disagreements
        FROM a LEFT JOIN b ON b.request_id = a.request_id""")),
    "g14_concept_normalise": (_g14, sql("""
        SELECT paper_id, concept, concept_type, round(round(confidence + 0.05, 2), 4) AS confidence FROM (
          SELECT *, row_number() OVER (PARTITION BY paper_id, concept, concept_type ORDER BY line_no, part_id, confidence) AS rn FROM concepts
          WHERE paper_id NOT IN (SELECT paper_id FROM concepts WHERE part_id % 50 = 0 OR round(confidence + 0.05, 2) > 1.0)) WHERE rn = 1""")),
}
