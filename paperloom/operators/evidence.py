"""Evidence assembly: rendering, budget, order, quarantine (F1-F8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.defaults import CONTEXT_CHARS, SECTION_LABELS

# Fence lines around one evidence record.
FENCE_OPEN = "<<<EVIDENCE"
FENCE_CLOSE = "EVIDENCE>>>"

# Wording that addresses the reader of a document.
INJECTION_PATTERNS = (
    r"\bignore (all |any )?(previous|prior|earlier|above) (instructions|rules|prompts)",
    r"\bdisregard (all |any )?(previous|prior|earlier|above)\b",
    r"\b(new|updated|revised) instructions\b",
    r"\bsystem override\b",
    r"\byou are now\b",
    r"\bdeveloper mode\b",
    r"\bpretend (that )?this (paper|document|study)\b",
    r"\bpretend (that )?you\b",
    r"\bact as (if|though|an?)\b",
    r"\bdo not mention that you\b",
    r"\bstate these as\b",
    r"\byou (must|should) (now )?(output|return|reply|respond|say)\b",
    r"\bfabricate\b",
    r"\breveal your (system )?(prompt|instructions)\b",
)
# A quoted span of at most 400 characters.
QUOTED = r"""["'‘’“”]([^"'‘’“”]{0,400})["'‘’“”]"""

_SHORT_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def json_string(text: Column) -> Column:
    """A JSON string literal; letters beyond ASCII stay as they are."""

    def escaped(t: Column) -> Column:
        out = t
        for raw, code in _SHORT_ESCAPES:
            out = F.replace(out, F.lit(raw), F.lit(code))
        rare = out
        for n in range(32):
            if chr(n) not in "\n\r\t\b\f":
                rare = F.replace(rare, F.lit(chr(n)), F.lit(f"\\u{n:04x}"))
        return F.when(t.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(out)

    return F.concat(F.lit('"'), let(text, escaped), F.lit('"'))


def render(chunk_id: Column, paper_id: Column, title: Column, section: Column, content: Column) -> Column:
    """one hit as a fenced JSON record."""
    shown = F.when(F.coalesce(title, F.lit("")) == "", "Untitled").otherwise(title)
    label = F.when(F.coalesce(section, F.lit("")) == "", "unknown").otherwise(section)
    fields = (
        ("chunk_id", chunk_id.cast("string")), ("paper_id", paper_id.cast("string")), ("paper_title", shown),
        ("section", F.translate(label, "_", " ")), ("text", content),
    )
    parts = [F.concat(F.lit(f'"{name}": '), json_string(value)) for name, value in fields]
    return F.concat(F.lit(FENCE_OPEN + "\n{"), F.concat_ws(", ", *parts), F.lit("}\n" + FENCE_CLOSE))


def section_rank(section: Column) -> Column:
    """place of a section in a paper; unknown ones go last."""
    at = F.array_position(F.array(*[F.lit(s) for s in SECTION_LABELS]), F.coalesce(section, F.lit("other")))
    return F.when(at > 0, at - 1).otherwise(F.lit(len(SECTION_LABELS) - 1)).cast("int")


def equal_shares(hits: DataFrame, budget: int = CONTEXT_CHARS, asked: DataFrame | None = None) -> DataFrame:
    """each compared paper gets the same part of the budget.

    ``asked``: query_id, paper_id of the papers to compare, with or without hits;
    left out, the papers that have hits count.
    """
    n = (hits if asked is None else asked).groupBy("query_id").agg(F.count_distinct("paper_id").alias("_n"))
    return hits.join(n, "query_id").withColumn("budget", F.floor(F.lit(budget) / F.col("_n")).cast("int")).drop("_n")


def pack(hits: DataFrame, budget: int = CONTEXT_CHARS, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """What fits the budget, best first, shown in document order.

    ``hits``: the keys, chunk_id, paper_id, paper_title, section_type,
    chunk_index, content, score and optionally a per-row ``budget``. They are the
    top-k of a query (at most 50), so a group is small by construction. A hit
    that would overflow is skipped and the next one tried. When none fits, the
    best is taken with its text cut.

    Gives the keys, ``kept`` (array of chunk_id, truncated, rendered in document
    order), ``used`` and ``context``.
    """
    limit = F.col("budget") if "budget" in hits.columns else F.lit(budget)
    whole = render(F.col("chunk_id"), F.col("paper_id"), F.col("paper_title"), F.col("section_type"), F.col("content"))
    cut = render(
        F.col("chunk_id"), F.col("paper_id"), F.col("paper_title"), F.col("section_type"),
        F.left("content", F.greatest(limit - 300, F.lit(300))),
    )
    rows = hits.select(
        *keys,
        limit.alias("_budget"),
        F.struct(
            (-F.col("score")).alias("worst_last"),
            F.col("chunk_id"),
            F.struct(
                F.lower(F.coalesce("paper_title", F.lit(""))).alias("title"), section_rank(F.col("section_type")).alias("section"),
                F.coalesce("chunk_index", F.lit(0)).alias("at"),
            ).alias("place"),
            whole.alias("whole"),
            cut.alias("cut"),
        ).alias("hit"),
    )
    groups = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("hit")).alias("hits"), F.first("_budget").alias("budget"))

    def step(state: Column, hit: Column) -> Column:
        total = state["used"] + F.length(hit["whole"])
        fits = total <= F.col("budget")
        return F.struct(
            F.when(fits, total).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["picked"], F.array(hit["chunk_id"]))).otherwise(state["picked"]).alias("picked"),
        )

    id_type = hits.schema["chunk_id"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<{id_type}>").alias("picked"))
    folded = groups.withColumn("fold", F.aggregate("hits", start, step))
    chosen = F.filter("hits", lambda h: F.array_contains(F.col("fold.picked"), h["chunk_id"]))
    shown = F.transform(
        chosen, lambda h: F.struct(h["place"].alias("place"), h["chunk_id"].alias("chunk_id"), F.lit(False).alias("truncated"), h["whole"].alias("rendered"))
    )
    best = F.element_at("hits", 1)
    fallback = F.array(
        F.struct(best["place"].alias("place"), best["chunk_id"].alias("chunk_id"), F.lit(True).alias("truncated"), best["cut"].alias("rendered"))
    )
    kept = F.when(F.size("fold.picked") == 0, fallback).otherwise(F.array_sort(shown))
    out = folded.select(*keys, kept.alias("kept"), F.col("fold.used").alias("used"))
    return out.withColumn("context", F.array_join("kept.rendered", "\n\n"))


def is_suspicious(text: Column) -> Column:
    """the passage instructs its reader outside quotation marks."""

    outside = F.regexp_replace(text, QUOTED, " ")
    return F.coalesce(outside.rlike("(?iU)" + "|".join(f"(?:{p})" for p in INJECTION_PATTERNS)), F.lit(False))


def screen(hits: DataFrame) -> DataFrame:
    """Hits with the flag and the columns claims are checked against."""
    return hits.withColumns(
        {
            "suspicious": is_suspicious(F.col("content")),
            "content": F.coalesce("content", F.lit("")),
            "paper_title": F.when(F.coalesce(F.col("paper_title"), F.lit("")) == "", "Untitled paper").otherwise(F.col("paper_title")),
        }
    )


def citable(screened: DataFrame) -> DataFrame:
    """the passages a claim may rest on."""
    return screened.filter(~F.col("suspicious"))
