"""Library screens and attribute edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, has_text, strip
from ..functions.defaults import READING_STATES
from ..session import materialise

PAGE_LIMIT = 100
#: A page that ends within so many rows is found by sorting that many in one task.
SHALLOW_ROWS = 10_000


def _order(sort: str | None) -> Column:
    # Null places follow the reference's database: ascending last, descending first.
    return {
        "title": F.asc_nulls_last("title"),
        "year": F.desc_nulls_first("publication_year"),
        "oldest": F.asc_nulls_last("created_at"),
        "updated": F.desc_nulls_first("updated_at"),
    }.get(sort or "", F.desc_nulls_first("created_at"))


def filter_papers(papers: DataFrame, user_id, *, project_id=None, status=None, year=None, reading_status=None,
                  query: str = "") -> DataFrame:
    """E13 filters; one is added only when it is set, so the scan sees just those."""
    out = papers.filter(F.col("user_id") == user_id)
    for column, value in (("project_id", project_id), ("processing_status", status or None),
                          ("publication_year", year), ("reading_status", reading_status or None)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if query.strip():
        out = out.filter(F.lower("title").contains(F.lower(F.lit(query.strip()))))
    return out


def page_of(rows: DataFrame, order: list[Column], page: int, size: int, *, shallow: int = SHALLOW_ROWS) -> DataFrame:
    """Rows ``page * size`` to ``page * size + size`` of ``rows`` in ``order``.

    Up to ``shallow`` rows deep each task hands on its first rows and one sorts
    them. A deeper page would send all rows before it through that task; there
    the rows are cut into ranges of the order and counted, and only the ranges
    that hold the page are read again and sorted. ``order`` has no ties.
    """
    begin, end = page * size, page * size + size
    if end <= shallow:
        return rows.orderBy(*order).offset(begin).limit(size)
    ranges = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialise(rows.repartitionByRange(ranges, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    # One row a range.
    counts = sorted(tuple(r) for r in ranged.groupBy("range_").agg(F.count(F.lit(1))).collect())
    wanted, before, seen = [], 0, 0
    for number, held in counts:
        if seen + held <= begin:
            before = seen + held
        elif seen < end:
            wanted.append(number)
        seen += held
    return ranged.filter(F.col("range_").isin(wanted)).drop("range_").orderBy(*order).offset(begin - before).limit(size)


def list_papers(papers: DataFrame, user_id, *, sort: str | None = None, page: int = 0, size: int = 20, **filters) -> DataFrame:
    """One page of a library with the totals of the whole selection."""
    size = min(size, PAGE_LIMIT)
    selected = filter_papers(papers, user_id, **filters)
    total = selected.agg(F.count(F.lit(1)).alias("total_items"))
    rows = page_of(selected, [_order(sort), F.asc("paper_id")], page, size)
    # ``total`` is one row by construction.
    return rows.crossJoin(F.broadcast(total)).withColumn("total_pages", F.ceil(F.col("total_items") / size))


def papers_by_tag(papers: DataFrame, tag: str, user_id=None) -> DataFrame:
    """Papers carrying a tag, newest change first."""
    out = papers.filter(F.array_contains("tags", tag))
    if user_id is not None:
        out = out.filter(F.col("user_id") == user_id)
    return out.orderBy(F.desc_nulls_first("updated_at"), "paper_id")


def analysis_history(analyses: DataFrame, user_id, *, analysis_type=None, project_id=None, paper_id=None,
                     page: int = 0, size: int = 20) -> DataFrame:
    """Stored analyses of a user, newest first."""
    size = min(size, PAGE_LIMIT)
    out = analyses.filter(F.col("user_id") == user_id)
    for column, value in (("analysis_type", analysis_type or None), ("project_id", project_id), ("paper_id", paper_id)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return page_of(out, [F.desc_nulls_first("created_at"), F.asc("analysis_id")], page, size)


def distinct_tags(papers: DataFrame) -> DataFrame:
    """The tags in use per user."""
    return papers.select("user_id", F.explode("tags").alias("tag")).distinct()


def clean_tags(tags: Column) -> Column:
    """Trimmed, blanks dropped, first of equal ones kept, order kept."""
    return F.array_distinct(F.transform(F.filter(tags, has_text), strip))


def apply_edits(papers: DataFrame, edits: DataFrame) -> DataFrame:
    """A batch of attribute edits (paper_id, user_id, title, tags, reading_status).

    Absent values leave the paper as it is; an edit by another owner does
    nothing; an unknown reading status rejects the whole edit.
    """
    ask = edits.select(
        "paper_id", "user_id", F.col("title").alias("new_title"), F.col("tags").alias("new_tags"),
        F.col("reading_status").alias("new_status"),
    )
    ok = F.col("new_status").isNull() | F.col("new_status").isin(*READING_STATES)
    joined = papers.join(ask, ["paper_id", "user_id"], "left").withColumn("_ok", F.coalesce(ok, F.lit(True)))
    return joined.select(
        *[c for c in papers.columns if c not in ("title", "tags", "reading_status")],
        F.when(F.col("_ok"), F.coalesce(strip(blank_to_null(F.col("new_title"))), F.col("title"))).otherwise(F.col("title")).alias("title"),
        F.when(F.col("_ok"), F.coalesce(clean_tags(F.col("new_tags")), F.col("tags"))).otherwise(F.col("tags")).alias("tags"),
        F.when(F.col("_ok"), F.coalesce("new_status", "reading_status")).otherwise(F.col("reading_status")).alias("reading_status"),
        F.when(~F.col("_ok"), "INVALID_READING_STATUS").alias("edit_error"),
    )
