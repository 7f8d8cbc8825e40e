"""Claims checked against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import alnum_key, collapse, has_text, let, strip
from ..session import materialise
from .evidence import is_suspicious

# What is shown when every claim rested on quarantined text.
QUARANTINE_ANSWER = (
    "This paper contains text written to instruct an assistant rather than to report research, so an answer drawn "
    "from it cannot be trusted. Nothing here is reliable enough to answer from."
)
QUARANTINE_LIMITS = (
    "Passages in this document attempt to direct the assistant's output. They were excluded from the evidence."
)
NOT_REPORTED = "Not reported"
SHORT_QUOTE = 24


def quote_supported(quote: Column, source: Column, minimum: int = SHORT_QUOTE) -> Column:
    """The quote's letters and digits stand in the source; a very short quote passes."""
    return _quoted(quote, alnum_key(F.coalesce(source, F.lit(""))), minimum)


def _quoted(quote: Column, key: Column, minimum: int = SHORT_QUOTE) -> Column:
    wanted = alnum_key(F.coalesce(quote, F.lit("")))
    return (F.length(wanted) < minimum) | key.contains(wanted)


def bounded_confidence(stated: Column, corpus_size: Column, best_similarity: Column | None = None) -> Column:
    """The stated confidence, lowered to what corpus size and match strength allow."""
    level = lambda c: F.when(c == "low", 0).when(c == "high", 2).otherwise(1)
    ceiling = F.when(corpus_size < 5, 0).when(corpus_size < 15, 1).otherwise(2)
    if best_similarity is not None:
        strength = F.when(best_similarity < 0.5, 0).when(best_similarity < 0.65, 1).otherwise(2)
        ceiling = F.least(ceiling, F.coalesce(strength, F.lit(2)))
    named = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), ceiling + 1)
    return F.when(level(stated) <= ceiling, stated).otherwise(named)


def gap_limitations(existing: Column, corpus_size: Column) -> Column:
    """G9 for gaps: the reply's own words, or what the result is based on."""
    base = F.concat(F.lit("Based only on the "), corpus_size.cast("string"), F.lit(" paper(s) indexed in this project."))
    return F.when(F.coalesce(existing, F.lit("")) != "", existing).otherwise(base)


def novelty_limitations(existing: Column, corpus_size: Column, external: Column) -> Column:
    """G9 for novelty: corpus and external counts always follow the reply's own words."""
    base = F.concat(
        F.lit("Based on "), corpus_size.cast("string"), F.lit(" paper(s) retrieved from your library"),
        F.when(external > 0, F.concat(F.lit(" and "), external.cast("string"), F.lit(" record(s) from academic search"))).otherwise(""),
        F.lit(". This is not a proof of novelty: the absence of similar work in this corpus does not mean none exists."),
    )
    return strip(F.concat_ws(" ", F.when(F.coalesce(existing, F.lit("")) != "", strip(existing)), base))


def drop_unsupported_claims(claims: DataFrame, citable: DataFrame) -> DataFrame:
    """Claims without a citation, or citing a passage of the request's citable set.

    ``claims``: request_id, pos, claim (with chunk_id). A reply has at most 20.
    """
    allowed = citable.select("request_id", F.col("chunk_id").cast("string").alias("_cited"), F.lit(True).alias("_ok")).distinct()
    cited = claims.withColumn("_cited", F.col("claim.chunk_id"))
    joined = cited.join(allowed, ["request_id", "_cited"], "left")
    return joined.filter(F.col("_cited").isNull() | F.col("_ok")).select(*claims.columns)


def ground_answers(parsed: DataFrame, screened: DataFrame) -> DataFrame:
    """G3 and G4 for question answering.

    ``parsed``: request_id, valid, result (qa). ``screened``: request_id,
    chunk_id, suspicious. An answer left without any claim is downgraded; when
    passages were quarantined its prose is replaced too.
    """
    good = parsed.filter("valid")
    claims = good.select("request_id", F.posexplode("result.claims").alias("pos", "claim"))
    kept = drop_unsupported_claims(claims, screened.filter(~F.col("suspicious")))
    folded = kept.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", "claim"))).alias("cs"))
    hidden = screened.groupBy("request_id").agg(F.count_if("suspicious").alias("quarantined"))
    rows = good.join(folded, "request_id", "left").join(hidden, "request_id", "left")
    n = F.coalesce(F.size("cs.claim"), F.lit(0))
    down = (F.greatest(n, F.lit(0)) == 0) & F.col("result.evidence_sufficient")
    replace = down & (F.coalesce("quarantined", F.lit(0)) > 0)
    return rows.select(
        "request_id",
        F.when(replace, QUARANTINE_ANSWER).otherwise(F.col("result.answer")).alias("answer"),
        F.coalesce(F.col("cs.claim"), F.filter(F.col("result.claims"), lambda c: F.lit(False))).alias("claims"),
        (F.col("result.evidence_sufficient") & ~down).alias("evidence_sufficient"),
        F.when(down, "low").otherwise(F.col("result.confidence")).alias("confidence"),
        F.when(replace, QUARANTINE_LIMITS).otherwise(F.col("result.limitations")).alias("limitations"),
    )


def supported_evidence(rows: DataFrame, citable: DataFrame) -> DataFrame:
    """G6 and G7 core: evidence entries whose passage is citable and holds the quote.

    ``rows``: request_id, keys..., ev (chunk_id, quote, ...). The passage decides
    which paper it came from, whatever the reply said. Evidence that was not
    screened before is screened here, and only where a reply quotes it rightly.
    """
    raw = "suspicious" not in citable.columns
    title = F.when(F.coalesce(F.col("paper_title"), F.lit("")) == "", "Untitled paper").otherwise(F.col("paper_title"))
    known = citable.select(
        "request_id", F.col("chunk_id").cast("string").alias("_cited"), F.col("paper_id").cast("string").alias("owner_paper"),
        (title if raw else F.col("paper_title")).alias("owner_title"),
        F.coalesce("content", F.lit("")).alias("_source"),
    )
    # All entries that cite a passage meet it at once: its letters are taken out and its patterns run once.
    cited = rows.groupBy("request_id", F.col("ev.chunk_id").alias("_cited")).agg(
        F.collect_list(F.struct(*[c for c in rows.columns if c != "request_id"])).alias("_entries"))
    joined = cited.join(known, ["request_id", "_cited"])
    quoted = let(alnum_key(F.col("_source")), lambda key: F.filter("_entries", lambda e: _quoted(e["ev"]["quote"], key)))
    # One expression of both sides: the patterns run behind the join, on quoted passages alone.
    fits = let(quoted, lambda es: F.when(F.size(es) > 0, F.when(~is_suspicious(F.col("_source")), es))) if raw else quoted
    found = joined.select("request_id", "owner_paper", "owner_title", F.explode(fits).alias("_e"))
    return found.select(*[c if c == "request_id" else F.col(f"_e.{c}").alias(c) for c in rows.columns], "owner_paper", "owner_title")


def ground_gaps(parsed: DataFrame, citable: DataFrame) -> DataFrame:
    """G6, G8, G9, G12 for research gaps.

    ``parsed``: request_id, corpus_size, valid, result (research_gap). A gap with
    no evidence left is dropped; at most 10 gaps of 10 entries per reply.
    """
    good = materialise(parsed.filter("valid").select("request_id", "corpus_size", "result"), "parsed")
    gaps = good.select("request_id", "corpus_size", F.posexplode("result.gaps").alias("gap_pos", "gap"))
    entries = gaps.select("request_id", "corpus_size", "gap_pos", F.col("gap").dropFields("evidence").alias("gap"),
                          F.posexplode("gap.evidence").alias("ev_pos", "ev"))
    held = supported_evidence(entries, citable)
    fixed = F.struct(
        "ev_pos", F.col("ev.chunk_id").alias("chunk_id"), F.col("owner_paper").alias("paper_id"),
        F.col("owner_title").alias("paper_title"), F.col("ev.section").alias("section"), F.col("ev.quote").alias("quote"),
    )
    per_gap = held.groupBy("request_id", "gap_pos").agg(
        F.first(F.struct("gap.statement", "gap.supporting_papers", "gap.why_underexplored",
                         bounded_confidence(F.col("gap.confidence"), F.col("corpus_size")).alias("confidence"))).alias("g"),
        F.array_sort(F.collect_list(fixed)).alias("evidence"),
    )
    per_reply = per_gap.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("gap_pos", "g", "evidence"))).alias("gaps")
    )
    return good.join(per_reply, "request_id", "left").select(
        "request_id",
        "corpus_size",
        "gaps",
        gap_limitations(F.col("result.limitations"), F.col("corpus_size")).alias("limitations"),
        F.coalesce(F.get("gaps", F.lit(0))["g"]["confidence"], F.lit("low")).alias("confidence"),
    )


def gap_confidence(gaps: DataFrame) -> DataFrame:
    """G12 on gap rows (request_id, gap_pos, confidence): the first kept gap's confidence."""
    return gaps.groupBy("request_id").agg(F.min_by("confidence", "gap_pos").alias("confidence"))


def ground_novelty(parsed: DataFrame, citable: DataFrame, strength: DataFrame) -> DataFrame:
    """G7-G9 for novelty.

    ``parsed``: request_id, corpus_size, n_external, valid, result (novelty);
    ``strength``: request_id, best_similarity. At most 20 entries per reply.
    """
    good = materialise(parsed.filter("valid").select("request_id", "corpus_size", "n_external", "result"), "parsed")
    entries = good.select("request_id", F.posexplode("result.evidence").alias("ev_pos", "ev"))
    held = supported_evidence(entries, citable).groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "ev_pos", F.col("ev.chunk_id").alias("chunk_id"), F.col("owner_paper").alias("paper_id"), F.col("ev.quote").alias("quote")
        ))).alias("evidence")
    )
    rows = good.join(held, "request_id", "left").join(strength, "request_id", "left")
    return rows.select(
        "request_id",
        "evidence",
        bounded_confidence(F.col("result.confidence"), F.col("corpus_size"), F.col("best_similarity")).alias("confidence"),
        novelty_limitations(F.col("result.limitations"), F.col("corpus_size"), F.col("n_external")).alias("limitations"),
    )


def review_references(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """References to papers that gave evidence, or all such papers when none is left.

    ``refs``: request_id, pos, paper_id, title, year. ``evidence``: request_id,
    paper_id, paper_title.
    """
    gave = evidence.groupBy("request_id", F.col("paper_id").cast("string").alias("paper_id")).agg(
        F.min(F.coalesce("paper_title", F.lit("Untitled paper"))).alias("title")
    )
    kept = refs.join(gave.select("request_id", "paper_id"), ["request_id", "paper_id"], "left_semi").select(
        "request_id", "paper_id", "title", "year", F.lit("cited").alias("origin")
    )
    rest = gave.join(kept.select("request_id").distinct(), "request_id", "left_anti").select(
        "request_id", "paper_id", "title", F.lit(None).cast("int").alias("year"), F.lit("contributed").alias("origin")
    )
    return kept.unionByName(rest)


def pad_values(values: Column, n_papers: Column) -> Column:
    """One value per compared paper; missing and blank ones say so."""
    filled = F.transform(values, lambda v: F.when(has_text(v), v).otherwise(NOT_REPORTED))
    return F.concat(filled, F.array_repeat(F.lit(NOT_REPORTED), F.greatest(n_papers - F.size(values), F.lit(0)).cast("int")))


def ground_comparison(parsed: DataFrame, asked: DataFrame) -> DataFrame:
    """Comparisons with the papers asked for and one value per paper.

    ``parsed``: request_id, valid, result (comparison). ``asked``: request_id,
    paper_id, title. A reply that names no papers gets the ones asked for; rows of
    values are padded to their number, and a value beyond it belongs to no paper.
    """
    wanted = asked.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("paper_id").cast("string").alias("paper_id"), F.coalesce("title", F.lit("Untitled paper")).alias("title")
    ))).alias("wanted"))
    rows = parsed.filter("valid").join(wanted, "request_id")
    named = F.when(F.size("result.papers") > 0, F.col("result.papers")).otherwise(F.col("wanted"))
    return rows.select(
        "request_id", named.alias("papers"),
        F.transform("result.dimensions", lambda d: F.struct(
            d["name"].alias("name"), F.slice(pad_values(d["values"], F.size("wanted")), F.lit(1), F.size("wanted")).alias("values"))).alias("dimensions"),
        F.col("result.confidence").alias("confidence"), F.col("result.limitations").alias("limitations"),
    )


def ground_reviews(parsed: DataFrame, evidence: DataFrame) -> DataFrame:
    """G10 and G8 for literature reviews: references of contributing papers, bounded confidence.

    ``parsed``: request_id, corpus_size, valid, result (literature_review);
    ``evidence``: request_id, paper_id, paper_title. At most 60 references a reply,
    or one per contributing paper.
    """
    good = parsed.filter("valid")
    refs = good.select("request_id", F.posexplode("result.references").alias("pos", "r")).select(
        "request_id", "pos", "r.paper_id", "r.title", "r.year")
    kept = review_references(refs, evidence.join(good.select("request_id"), "request_id", "left_semi"))
    listed = kept.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("paper_id", "title", "year"))).alias("references"))
    return good.join(listed, "request_id", "left").select(
        "request_id", "references",
        bounded_confidence(F.col("result.confidence"), F.col("corpus_size")).alias("confidence"),
    )


def second_opinion(first: DataFrame, second: DataFrame, *, enabled: bool = True) -> DataFrame:
    """Points two replies share and points only one makes.

    Both: request_id, points (array). A request without a second reply says so.
    """
    norm = lambda a: F.array_distinct(F.transform(a, lambda p: F.lower(collapse(p))))
    a = first.select("request_id", norm(F.col("points")).alias("a"))
    b = second.select("request_id", norm(F.col("points")).alias("b"))
    none = F.array().cast("array<string>")
    available = F.col("b").isNotNull() & F.lit(enabled)
    return a.join(b, "request_id", "left").select(
        "request_id",
        F.lit(enabled).alias("enabled"),
        available.alias("second_opinion_available"),
        F.when(available, F.array_intersect("a", "b")).otherwise(none).alias("agreements"),
        F.when(available, F.concat(F.array_except("a", "b"), F.array_except("b", "a"))).otherwise(none).alias("disagreements"),
    )
