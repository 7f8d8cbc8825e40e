"""Metadata recovery from first-page text and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, collapse, let, strip, words

# Identifier, year and e-mail patterns.
DOI = r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b"
ARXIV = r"(?i)arXiv:\s*(\d{4}\.\d{4,5})"
YEAR = r"\b(19[5-9]\d|20[0-4]\d)\b"
EMAIL = r"\S+@\S+"

# Line openings that are never a title.
NOISE_PREFIXES = (
    "arxiv:", "doi:", "http", "www.", "issn", "isbn", "vol.", "volume ",
    "proceedings", "conference on", "journal of", "preprint", "submitted",
    "accepted", "published", "copyright", "©", "license", "under review",
)
# Legal wording that is never a title.
LEGAL_PHRASES = (
    "proper attribution", "permission to reproduce", "all rights reserved",
    "is licensed under", "creative commons", "for personal use",
    "redistribution", "provided that copies",
)
# Subject words that rule out a person's name.
SUBJECT_WORDS = (
    "learning", "network", "networks", "model", "models", "deep", "neural",
    "attention", "transformer", "transformers", "language", "vision", "graph",
    "data", "search", "analysis", "review", "survey", "study", "method",
    "methods", "system", "systems", "generation", "retrieval", "embedding",
    "embeddings", "large", "machine", "quantum", "climate", "cancer",
)
# Marks that follow an author's name.
AUTHOR_MARKS = r"(?U)[\d\*†‡§¶#⋆★☆✦✳∗♦]"


def doi(text: Column) -> Column:
    """The first DOI, without trailing punctuation."""
    return blank_to_null(F.regexp_replace(F.regexp_extract(text, DOI, 0), r"[.,;]+$", ""))


def arxiv_id(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, ARXIV, 1))


def publication_year(text: Column, as_of: int, creation_date: Column | None = None) -> Column:
    """Latest plausible year on the page, else the file's creation year.

    When every year on the page lies in the future there is no year.
    """
    found = F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    stamp = F.regexp_extract(F.coalesce(creation_date, F.lit("")), r"(?:19|20)\d{2}", 0) if creation_date is not None else F.lit("")
    year = F.when(stamp != "", stamp.cast("int"))
    fallback = F.when(year.between(1950, as_of), year)
    return let(
        found,
        lambda ys: F.when(F.size(ys) > 0, F.array_max(F.filter(ys, lambda y: y <= as_of))).otherwise(fallback),
    )


def _opens_with_noise(lowered: Column) -> Column:
    out = F.lit(False)
    for prefix in NOISE_PREFIXES:
        out = out | lowered.startswith(prefix)
    return out


def _has_legal(lowered: Column) -> Column:
    out = F.lit(False)
    for phrase in LEGAL_PHRASES:
        out = out | lowered.contains(phrase)
    return out


def plausible_title_line(line: Column) -> Column:
    """8..250 characters and no noise, legal wording, e-mail or DOI."""
    low = F.lower(line)
    return (
        F.length(line).between(8, 250) & ~_opens_with_noise(low) & ~_has_legal(low)
        & ~line.rlike(EMAIL) & ~line.rlike(DOI)
    )


def plausible_title(value: Column) -> Column:
    """An embedded or proposed title that is not a leftover file name."""
    low = F.lower(value)
    return F.coalesce(
        F.length(value).between(8, 250) & ~low.endswith(".dvi") & ~low.endswith(".pdf")
        & ~low.startswith("microsoft word") & ~low.startswith("untitled"),
        F.lit(False),
    )


def page_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n?|\n"), strip), lambda l: l != "")


def _until_abstract(lines: Column) -> Column:
    """The lines before the first one that opens with ``abstract``."""

    def cut(ls: Column) -> Column:
        at = F.array_position(F.transform(ls, lambda l: F.lower(l).startswith("abstract")), F.lit(True))
        return let(at, lambda n: F.when(n > 0, F.slice(ls, F.lit(1), (n - 1).cast("int"))).otherwise(ls))

    return let(lines, cut)


def title_from_lines(lines: Column) -> Column:
    """C10, line form: the first one or two plausible lines of the first 14."""
    candidates = F.filter(F.slice(lines, 1, 14), plausible_title_line)
    chosen = F.slice(_until_abstract(candidates), 1, 2)
    joined = F.regexp_replace(strip(F.array_join(chosen, " ")), r"\.$", "")
    return let(joined, lambda t: F.when(F.length(t) >= 8, collapse(t)))


def title_from_blocks(blocks: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """C10, block form: the largest plausible block; the higher one wins a tie."""
    ok = blocks.filter(plausible_title_line(F.col("text")))
    return ok.groupBy(id_col).agg(
        F.max_by(F.struct("text", "top"), F.struct(F.round("font_size", 1), -F.col("top"))).alias("b")
    ).select(id_col, collapse(F.col("b.text")).alias("title"), F.col("b.top").alias("title_top"))


def best_title(block_title: Column, embedded: Column, lines: Column) -> Column:
    return F.coalesce(block_title, F.when(plausible_title(embedded), collapse(embedded)), title_from_lines(lines))


def looks_like_name(value: Column) -> Column:
    """Two to five words, no digit, at least two capitalised."""
    return let(
        words(value),
        lambda ws: F.size(ws).between(2, 5)
        & ~value.rlike(r"\p{Nd}")
        & (F.size(F.filter(ws, lambda w: w.rlike(r"^\p{Lu}"))) >= 2),
    )


def author_names(line: Column) -> Column:
    """C11: names on one byline, null when it does not read as a byline."""
    cleaned = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(line, AUTHOR_MARKS, ""), r"(?U)\s+", " "), r"^[ ,;]+|[ ,;]+$", ""
    )

    def parse(text: Column) -> Column:
        parts = F.transform(F.split(text, r",| and |&|;"), lambda p: F.regexp_replace(p, r"^[ .]+|[ .]+$", ""))
        names = F.filter(parts, lambda p: (p != "") & looks_like_name(p))
        return let(
            names,
            lambda ns: F.when(
                (text != "") & (F.length(text) <= 300) & ((F.size(ns) >= 2) | ((F.size(ns) == 1) & text.contains(","))),
                F.slice(ns, 1, 25),
            ),
        )

    return let(cleaned, parse)


def _first_byline(lines: Column) -> Column:
    usable = F.filter(_until_abstract(lines), lambda l: ~l.rlike(EMAIL) & ~_opens_with_noise(F.lower(l)))
    return F.get(F.filter(F.transform(usable, author_names), lambda n: n.isNotNull()), F.lit(0))


def authors_from_lines(lines: Column, title: Column) -> Column:
    """C11: first byline among the eight lines after the title."""

    def look(ls: Column, known: Column) -> Column:
        inside = F.transform(F.slice(ls, 1, 14), lambda l, i: F.when(known.contains(l), i + 1).otherwise(0))
        start = F.coalesce(F.array_max(inside), F.lit(0))
        return _first_byline(F.slice(ls, start + 1, F.lit(8)))

    return let(lines, lambda ls: let(F.coalesce(title, F.lit("")), lambda known: look(ls, known)))


def authors_from_blocks(blocks: DataFrame, titles: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """C11, block form: first byline among the six blocks below the title block."""
    below = blocks.join(titles.select(id_col, "title_top"), id_col, "left").filter(
        F.col("title_top").isNull() | (F.col("top") > F.col("title_top"))
    )
    # A first page holds a bounded number of blocks.
    ordered = below.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("top", "text"))).alias("bs"))
    head = _until_abstract(F.slice(F.col("bs.text"), 1, 6))
    return ordered.select(
        id_col, F.get(F.filter(F.transform(head, author_names), lambda n: n.isNotNull()), F.lit(0)).alias("authors")
    )


def merge_metadata(papers: DataFrame, proposals: DataFrame, as_of: int) -> DataFrame:
    """Each proposed field replaces the old one only when it is acceptable.

    ``proposals``: paper_id, title, authors, publication_year, venue.
    """
    new = proposals.select(
        "paper_id", F.col("title").alias("n_title"), F.col("authors").alias("n_authors"),
        F.col("publication_year").alias("n_year"), F.col("venue").alias("n_venue"),
    )
    title = F.when(plausible_title(F.col("n_title")), F.left(collapse(F.col("n_title")), F.lit(1000)))
    names = F.filter(F.transform("n_authors", collapse), looks_like_name)
    authors = let(names, lambda ns: F.when(F.size(ns) > 0, F.slice(ns, 1, 25)))
    year = F.when(F.col("n_year").between(1950, as_of), F.col("n_year"))
    venue = F.when(F.length("n_venue").between(4, 500), collapse(F.col("n_venue")))
    keep = [c for c in papers.columns if c not in ("title", "authors", "publication_year", "venue")]
    return papers.join(new, "paper_id", "left").select(
        *keep,
        F.coalesce(title, "title").alias("title"),
        F.coalesce(authors, "authors").alias("authors"),
        F.coalesce(year, "publication_year").alias("publication_year"),
        F.coalesce(venue, "venue").alias("venue"),
    )


def is_person_name(query: Column) -> Column:
    """C14: two to four capitalised letter-only words, none of them a subject word."""
    bare = F.transform(words(query), lambda w: F.regexp_replace(w, r"[.\-']", ""))
    subjects = F.array(*[F.lit(w) for w in SUBJECT_WORDS])
    return let(
        bare,
        lambda ws: F.size(ws).between(2, 4)
        & F.forall(ws, lambda w: w.rlike(r"^\p{Lu}\p{L}*$"))
        & ~F.arrays_overlap(F.transform(ws, F.lower), subjects),
    )


def first_page_metadata(docs: DataFrame, as_of: int, *, blocks: DataFrame | None = None, page_col: str = "first_page",
                        id_col: str = "paper_id") -> DataFrame:
    """C8-C11 over first-page text; with ``blocks`` (id, text, font_size, top) typography decides first.

    The title is that of the largest plausible block, else the file's
    ``embedded_title`` if ``docs`` has that column and it is plausible, else the
    first plausible lines. Authors are looked for below the title's block, then
    in the lines after the title. A page without blocks is read by its lines.
    """
    page = F.col(page_col)
    rows = docs.withColumn("_lines", page_lines(page))
    embedded = F.col("embedded_title") if "embedded_title" in docs.columns else F.lit(None).cast("string")
    by_blocks = F.lit(None).cast("array<string>")
    largest = F.lit(None).cast("string")
    if blocks is not None:
        titles = title_from_blocks(blocks, id_col)
        found = titles.join(authors_from_blocks(blocks, titles, id_col), id_col, "full").select(
            id_col, F.col("title").alias("_block_title"), F.col("authors").alias("_block_authors"))
        rows = rows.join(found, id_col, "left")
        by_blocks, largest = F.col("_block_authors"), F.col("_block_title")
    rows = rows.withColumn("_title", best_title(largest, embedded, F.col("_lines")))
    return rows.select(
        id_col,
        F.col("_title").alias("title"),
        F.coalesce(by_blocks, authors_from_lines(F.col("_lines"), F.col("_title"))).alias("authors"),
        publication_year(page, as_of).alias("publication_year"),
        doi(page).alias("doi"),
        arxiv_id(page).alias("arxiv_id"),
    )
