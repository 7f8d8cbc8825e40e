"""Exact dedup by content-defined chunk recipes (operator 8, DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import is_empty, lower_ascii, unused

#: A chunk holds at least this many characters before a boundary counts, and at most this many.
MIN_CHUNK, MAX_CHUNK = 64, 8192


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    """A chunk ends between two words by the last letters of the one and the first of the other.

    About one place between words in a hundred qualifies, whatever stands before,
    so the same passage is cut alike wherever it occurs.
    """
    return rf"(?s).{{{least},{most}}}?(?:(?<=[a-k][a-j][.,!?]?\s)(?=[a-g][a-i])|\z)|.{{1,{most}}}"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Content-defined chunks, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = lower_ascii,
            chunk_id: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, text_sha256, recipe, contested): each text as the ordered identifiers of its chunks.

    A chunk's identifier is verified: all chunks of one identifier must have the
    same SHA-256. A text with a chunk whose identifier stands for different
    chunks is ``contested`` and carries its own SHA-256 there, which then
    separates what the recipes cannot.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), normalise(F.col(text)).alias("text"))
    rows = read.select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"),
        F.transform(chunks(F.col("text")), lambda c: chunk_id(c)).alias("recipe"),
        F.lit(None).cast("string").alias("contested"),
    )
    pieces = read.select(F.explode(F.transform(
        chunks(F.col("text")), lambda c: F.struct(chunk_id(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("sha")))
    ).alias("chunk")).select("chunk.*")
    shared = pieces.groupBy("id").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).filter("a <> b").select("id")
    if is_empty(shared):
        return rows
    marked = rows.select("text_sha256", F.explode("recipe").alias("id")).join(shared, "id", "left_semi").select(
        "text_sha256").distinct().withColumn("clash", F.lit(True))
    return rows.join(marked, "text_sha256", "left").select(
        "doc_id", "text_sha256", "recipe", F.when(F.col("clash"), F.col("text_sha256")).alias("contested"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 normalise: Callable[[Column], Column] = lower_ascii,
                 chunk_id: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when they are the same after ``normalise`` (A-Z lower-cased).
    They are compared as ordered lists of verified chunk identifiers, so no text
    is shuffled: a document of any length moves as eight bytes per chunk. Of
    equal texts the row with the largest ``doc_id`` stays.

    A group is counted before it is shuffled, and its one result row is joined
    back, so a group may hold any share of the rows. A null text equals an empty
    one. A null ``doc_id`` is smaller than any number; a group of null ids alone
    has a null ``keep_id`` and keeps one row. Of rows repeated with the same id
    and text exactly one is kept. An empty table gives no rows; other columns
    are not read.
    """
    rows = recipes(docs, doc_id, text, normalise, chunk_id)
    equal = rows.withColumn("contested", F.coalesce("contested", F.lit("")))
    each = equal.groupBy("doc_id", "recipe", "contested", "text_sha256").agg(F.count("*").alias("n"))
    groups = each.groupBy("recipe", "contested").agg(
        F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    joined = each.join(groups, ["recipe", "contested"])
    return joined.select(
        "doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "text_sha256"
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; one of each group.

    Null, empty and very long texts, null ids and empty tables are as in ``exact_groups``.

    Rows repeated with the same id and text are merged by their full content only
    when there are any.
    """
    decided = exact_groups(docs, doc_id, text)
    kid, ksha, sha, copies = unused(docs, "kept_id", "kept_sha", "text_sha", "copies")
    kept = decided.filter("kept").select(F.col("doc_id").alias(kid), F.col("text_sha256").alias(ksha))
    hashed = docs.withColumn(sha, F.sha2(lower_ascii(F.col(text)), 256))
    out = hashed.join(kept, F.col(doc_id).eqNullSafe(F.col(kid)) & (F.col(sha) == F.col(ksha)), "left_semi")
    repeated = hashed.groupBy(doc_id, sha).agg(F.count("*").alias(copies)).filter(F.col(copies) > 1)
    if not is_empty(repeated):
        out = out.dropDuplicates([doc_id, sha])
    return out.drop(sha)
