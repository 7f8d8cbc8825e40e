"""Section detection inside one document row (B8-B13); no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import collapse, let, strip, words
from .cleaning import unify_newlines

# Heading patterns, tried in this order.
HEADING_PATTERNS = (
    ("abstract", r"^abstract\b"),
    ("future_work", r"^((conclusions?|discussion|summary)\s+and\s+future\s+work"
                    r"|future\s+(work|directions|research)|further\s+work)\b"),
    ("limitations", r"^(limitations?|threats\s+to\s+validity)\b"),
    ("related_work", r"^(related\s+work|literature\s+review|background(\s+and\s+related\s+work)?|prior\s+work)\b"),
    ("introduction", r"^(introduction|motivation)\b"),
    ("methodology", r"^(methodolog(y|ies)|methods?|approach|proposed\s+(method|approach|model|framework|system)"
                    r"|materials\s+and\s+methods|system\s+(design|architecture)|implementation)\b"),
    ("results", r"^(results?|experiments?|experimental\s+(results|setup|evaluation)|evaluation|findings|performance)\b"),
    ("discussion", r"^(discussions?|analysis)\b"),
    ("conclusion", r"^(conclusions?|concluding\s+remarks|summary)\b"),
    ("references", r"^(references?|bibliography|works\s+cited)\b"),
)
# Section numbers before a heading, and the limits of a heading.
NUMBER_PREFIX = r"^\s*(?:\d{1,2}(?:\.\d{1,2}){0,3}|[IVXLC]{1,6}|[A-H])[.)]?\s+"
MAX_HEADING_WORDS = 8
MAX_HEADING_CHARS = 90

SECTION_TYPE = "array<struct<section_type:string,heading:string,content:string>>"


def heading_label(line: Column) -> Column:
    """The section label of a heading line, else null.

    Long lines are turned away before any pattern runs. A trailing colon is
    stripped with the other edge marks, so it does not bar a heading.
    """

    def classify(candidate: Column) -> Column:
        label = F.lit(None).cast("string")
        for name, pattern in reversed(HEADING_PATTERNS):
            label = F.when(candidate.rlike("(?iU)" + pattern), name).otherwise(label)
        fits = (F.size(words(candidate)) <= MAX_HEADING_WORDS) & ~candidate.rlike(r"[.!?,;]$") & (candidate != "")
        return F.when(fits, label)

    def examine(text: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(text, "(?iU)" + NUMBER_PREFIX, ""), r"^[ :–—-]+|[ :–—-]+$", "")
        return F.when((text != "") & (F.length(text) <= MAX_HEADING_CHARS), let(bare, classify))

    return let(strip(line), examine)


def raw_sections(text: Column) -> Column:
    """Front matter and one section per heading; empty bodies are skipped.

    Null when the text has no heading or nothing between headings.
    """

    def body(lines: Column, start: Column, stop: Column) -> Column:
        return strip(F.array_join(F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0))), "\n"))

    def front(lines: Column, marks: Column) -> Column:
        opening = body(lines, F.lit(0), F.element_at(marks, 1)["at"])
        label = lambda t: F.when(
            F.lower(F.left(t, F.lit(400))).contains("abstract") | (F.length(t) > 300), "abstract"
        ).otherwise("other")
        return F.transform(
            F.filter(F.array(opening), lambda t: t != ""),
            lambda t: F.struct(label(t).alias("section_type"), F.lit("Front matter").alias("heading"), t.alias("content")),
        )

    def cut(lines: Column, marks: Column) -> Column:
        def one(mark: Column, n: Column) -> Column:
            stop = F.coalesce(F.get(marks, n + 1)["at"], F.size(lines))
            return F.struct(
                mark["label"].alias("section_type"), strip(mark["line"]).alias("heading"),
                body(lines, mark["at"] + 1, stop).alias("content"),
            )

        return F.filter(F.transform(marks, one), lambda s: s["content"] != "")

    def split(lines: Column) -> Column:
        labelled = F.transform(
            lines, lambda l, i: F.struct(i.alias("at"), l.alias("line"), heading_label(l).alias("label"))
        )
        marks = F.filter(labelled, lambda m: m["label"].isNotNull())
        return let(
            marks,
            lambda ms: F.when(
                F.size(ms) > 0,
                F.concat(front(lines, ms).cast(SECTION_TYPE), cut(lines, ms).cast(SECTION_TYPE)),
            ),
        )

    found = let(F.split(unify_newlines(text), "\n"), split)
    return let(found, lambda s: F.when(F.size(s) > 0, s))


def merge_adjacent(sections: Column) -> Column:
    """Neighbours with one label become one section; ``other`` never merges."""

    def merged(ss: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ss) - 1)
        starts = F.filter(
            places,
            lambda i: (i == 0)
            | (F.get(ss, i)["section_type"] != F.get(ss, i - 1)["section_type"])
            | (F.get(ss, i)["section_type"] == "other"),
        )

        def island(at: Column, n: Column, marks: Column) -> Column:
            stop = F.coalesce(F.get(marks, n + 1), F.size(ss))
            rest = F.transform(
                F.slice(ss, at + 2, stop - at - 1), lambda s: F.concat(s["heading"], F.lit("\n"), s["content"])
            )
            head = F.get(ss, at)
            return F.struct(
                head["section_type"].alias("section_type"), head["heading"].alias("heading"),
                F.array_join(F.concat(F.array(head["content"]), rest), "\n\n").alias("content"),
            )

        return let(starts, lambda ms: F.transform(ms, lambda at, n: island(at, n, ms)))

    return let(sections, lambda ss: F.when(ss.isNotNull(), merged(ss)))


def whole_document(text: Column, abstract_hint: Column | None = None) -> Column:
    """The sections of a document without usable headings."""
    document = F.struct(F.lit("other").alias("section_type"), F.lit("Document").alias("heading"), text.alias("content"))
    if abstract_hint is None:
        return F.array(document).cast(SECTION_TYPE)
    hint = F.struct(
        F.lit("abstract").alias("section_type"), F.lit("Abstract").alias("heading"), abstract_hint.alias("content")
    )
    return F.when(F.coalesce(abstract_hint, F.lit("")) != "", F.array(hint, document)).otherwise(F.array(document)).cast(
        SECTION_TYPE
    )


def detect_sections(
    docs: DataFrame, *, id_col: str = "paper_id", text_col: str = "text", abstract_hint: str | None = None,
    merge: bool = True,
) -> DataFrame:
    """One row per section: id, order_index, section_type, heading, content."""
    text = F.col(text_col)
    found = raw_sections(text)
    if merge:
        found = merge_adjacent(found)
    fallback = whole_document(text, F.col(abstract_hint) if abstract_hint else None)
    sections = docs.select(id_col, F.posexplode(F.coalesce(found, fallback)).alias("order_index", "s"))
    return sections.select(id_col, "order_index", "s.section_type", "s.heading", "s.content")


def clean_abstract(text: Column, *, least: int = 80, most: int = 6000) -> Column:
    """The leading word goes; too short gives null; long text is cut."""
    body = collapse(F.regexp_replace(strip(text), r"(?iU)^\s*abstract[\s:.-]*", ""))
    return let(body, lambda b: F.when(F.length(b) >= least, F.left(b, F.lit(most))))


def abstracts(sections: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """The first section labelled abstract of each paper, cleaned."""
    first = sections.filter(F.col("section_type") == "abstract").groupBy(id_col).agg(
        F.min_by("content", "order_index").alias("content")
    )
    return first.select(id_col, clean_abstract(F.col("content")).alias("abstract"))


def section_report(sections: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """Characters per section in reading order."""
    return sections.select(
        id_col, "order_index", "section_type", "heading", F.coalesce(F.length("content"), F.lit(0)).alias("characters")
    )
