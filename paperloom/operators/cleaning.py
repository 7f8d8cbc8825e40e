"""Page and document text cleaning."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import has_text, let, strip
from ..functions.defaults import MAX_CHARS, MAX_PAGES, MIN_DOC_CHARS

# Page furniture patterns.
PAGE_NUMBER = r"(?iU)^\s*(?:page\s+)?[-–—\[(]?\s*\d{1,4}\s*(?:/\s*\d{1,4})?[-–—\])]?\s*$"
URL_ONLY = r"(?iU)^\s*(?:https?://|www\.)\S+\s*$"


TRAILING_BLANKS = r"[ \t\r\f\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+(?=\n|$)"


def strip_control(text: Column) -> Column:
    """B1: drop C0 controls (tab, line feed and carriage return stay), DEL and C1."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """B2: Unicode compatibility form; it also spells out ligatures."""
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def expand_ligatures(text: Column) -> Column:
    """B2 without Python: enough where only Latin ligatures matter."""
    out = text
    # Latin ligatures and their letters.
    for glyph, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    return out


def join_hyphens(text: Column) -> Column:
    """Words cut at a line end are joined; soft hyphens go."""
    joined = F.regexp_replace(text, r"(?U)(\w)[-\u00ad]\s*\n\s*(\w)", "$1$2")
    return F.replace(joined, F.lit("\u00ad"), F.lit(""))


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?|[\u2028\u2029]", "\n")


def tidy_space(text: Column) -> Column:
    """Right-trimmed lines, single blanks, at most one empty line, trimmed ends."""
    lines = F.regexp_replace(unify_newlines(text), TRAILING_BLANKS, "")
    blanks = F.regexp_replace(lines, "[ \t\u00a0]{2,}", " ")
    return strip(F.regexp_replace(blanks, r"\n{3,}", "\n\n"))


def clean_text(text: Column, *, unicode_form: bool = True) -> Column:
    """B1-B4 in order. ``unicode_form=False`` keeps the whole chain inside the JVM."""
    plain = strip_control(text)
    spelled = nfkc(plain) if unicode_form else expand_ligatures(plain)
    return tidy_space(join_hyphens(spelled))


def is_furniture(line: Column) -> Column:
    """A bare page number or a bare URL."""
    return line.rlike(PAGE_NUMBER) | line.rlike(URL_ONLY)


def strip_running_lines(pages: DataFrame, *, min_pages: int = 4, share: float = 0.5) -> DataFrame:
    """Remove repeated headers and footers, page numbers and URL lines.

    ``pages``: doc_id, page_no, text. Only the first and last line of each page
    are shuffled; the repeated lines of a document (at most ``2 / share``, or two
    per three pages) come back to its pages as one small array.
    """
    lines = F.split(unify_newlines(F.col("text")), "\n")
    ends = pages.select(
        "doc_id",
        let(
            F.transform(F.filter(lines, has_text), strip),
            lambda ls: F.when(
                F.size(ls) > 0,
                F.array(F.struct(F.lit("first").alias("side"), F.element_at(ls, 1).alias("line")),
                        F.struct(F.lit("last").alias("side"), F.element_at(ls, -1).alias("line"))),
            ),
        ).alias("ends"),
    )
    totals = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    seen = ends.select("doc_id", F.inline("ends")).groupBy("doc_id", "side", "line").agg(F.count(F.lit(1)).alias("n"))
    often = seen.join(totals, "doc_id").filter(
        (F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("n_pages") * share))) & (F.col("n_pages") >= min_pages)
    )
    repeated = often.groupBy("doc_id").agg(F.collect_set("line").alias("repeated"))
    per_doc = totals.join(repeated, "doc_id", "left")
    none = F.array().cast("array<string>")
    joined = pages.join(per_doc, "doc_id", "left").withColumn("repeated", F.coalesce("repeated", none))
    kept = F.filter(lines, lambda l: ~F.array_contains(F.col("repeated"), strip(l)) & ~is_furniture(l))
    text = F.when(F.col("n_pages") >= min_pages, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return joined.withColumn("text", text).drop("repeated", "n_pages")


def gate_documents(
    pages: DataFrame, *, max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS
) -> DataFrame:
    """B7 before assembly: page and character totals with a reject code."""
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.sum(F.length("text").cast("bigint")).alias("raw_chars")
    ).withColumn(
        "reject_code",
        F.when((F.col("page_count") > max_pages) | (F.col("raw_chars") > max_chars), "PDF_TOO_COMPLEX"),
    )


def assemble_documents(
    pages: DataFrame, *, max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS, min_chars: int = MIN_DOC_CHARS,
    share: float = 0.5, unicode_form: bool = True,
) -> DataFrame:
    """Pages to cleaned documents: doc_id, page_count, raw_chars, reject_code, text, first_page.

    Documents over the limits are turned away on their totals, before any text
    is gathered, so a gathered document is bounded by the same limits.
    """
    gates = gate_documents(pages, max_pages=max_pages, max_chars=max_chars)
    fit = gates.filter(F.col("reject_code").isNull()).select("doc_id")
    stripped = strip_running_lines(pages.join(fit, "doc_id", "left_semi"), share=share)
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    bodies = stripped.groupBy("doc_id").agg(ordered.alias("ps")).select(
        "doc_id",
        clean_text(F.array_join(F.col("ps.text"), "\n\n"), unicode_form=unicode_form).alias("text"),
        clean_text(F.element_at("ps", 1)["text"], unicode_form=unicode_form).alias("first_page"),
    )
    empty = F.length("text") < min_chars
    return gates.join(bodies, "doc_id", "left").select(
        "doc_id", "page_count", "raw_chars",
        F.coalesce("reject_code", F.when(empty, "NO_EXTRACTABLE_TEXT")).alias("reject_code"),
        "text", "first_page",
    )
