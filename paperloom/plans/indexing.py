"""Documents to searchable passages, in one job over all new documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import chunk_sections, plan_chunks
from ..operators.cleaning import clean_text
from ..operators.duplicates import attach_duplicates, opening_duplicates
from ..operators.metadata import first_page_metadata
from ..operators.retrieval import encode_hashed
from ..operators.sections import abstracts, detect_sections


def index_documents(docs: DataFrame, *, size: int | None = None, overlap: int | None = None, encode=encode_hashed, **chunk_options) -> DataFrame:
    """Cleaned, labelled, cut and encoded passages of ``docs`` (paper_id, text)."""
    planned, carried = plan_chunks()
    cleaned = docs.select("paper_id", clean_text(F.col("text")).alias("text"))
    chunks = chunk_sections(detect_sections(cleaned), size=size or planned, overlap=carried if overlap is None else overlap, **chunk_options)
    return encode(chunks)


def describe_documents(docs: DataFrame, as_of: int, blocks: DataFrame | None = None) -> DataFrame:
    """Recovered metadata with the abstract, for ``docs`` (paper_id, text, first_page[, embedded_title]) and the font
    blocks of their first pages."""
    found = first_page_metadata(docs, as_of, blocks=blocks)
    return found.join(abstracts(detect_sections(docs)), "paper_id", "left")


def flag_duplicates(papers: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """Papers with the duplicate flag of their opening passage."""
    return attach_duplicates(papers, opening_duplicates(chunks, papers, **options))
