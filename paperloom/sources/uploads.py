"""Uploaded files: binary scan, validation, fingerprint, title and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, collapse, has_text, let
from ..functions.defaults import MAX_UPLOAD_BYTES

# File marker and the leading bytes searched for it.
MARKER = "%PDF-"
MARKER_WINDOW = 1024


def scan_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """A2: files as rows (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def looks_like_pdf(content: Column) -> Column:
    """A2: the marker stands anywhere in the first 1,024 bytes."""
    head = F.decode(F.substring(content, 1, MARKER_WINDOW), "ISO-8859-1")
    return F.coalesce(F.locate(MARKER, head) > 0, F.lit(False))


def reject_code(content: Column, length: Column | None = None, max_bytes: int = MAX_UPLOAD_BYTES) -> Column:
    """A3: why a file is refused, or null. ``length`` spares reading big content."""
    size = F.octet_length(content) if length is None else length
    return (
        F.when(size.isNull() | (size == 0), "EMPTY_FILE")
        .when(size > max_bytes, "FILE_TOO_LARGE")
        .when(~looks_like_pdf(content), "UNSUPPORTED_FILE_TYPE")
    )


def fingerprint(content: Column) -> Column:
    """A4: SHA-256 in hex."""
    return F.sha2(content, 256)


def title_from_filename(name: Column) -> Column:
    """A5: a readable provisional title."""
    base = F.regexp_replace(name, r"(?s)^.*[/\\]", "")
    stem = F.regexp_replace(base, r"(?i)\.pdf$", "")
    title = let(collapse(F.translate(stem, "_-", "  ")), lambda t: F.left(blank_to_null(t), F.lit(300)))
    return F.coalesce(F.when(has_text(name), title), F.lit("Untitled paper"))


def object_key(user_id: Column, paper_id: Column) -> Column:
    """Where the original file of a paper is kept."""
    return F.concat(F.lit("papers/"), user_id.cast("string"), F.lit("/"), paper_id.cast("string"), F.lit("/original.pdf"))


def validate_uploads(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """A3: each file gets its own outcome; one bad file never fails the batch."""
    code = reject_code(F.col("content"), F.col("length") if "length" in files.columns else None, max_bytes)
    return files.withColumn("reject_code", code).withColumn(
        "content_hash", F.when(F.col("reject_code").isNull(), fingerprint(F.col("content")))
    )
