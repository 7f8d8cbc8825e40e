"""A training corpus from raw documents: a few filtering stages, then tokens."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from paperloom.llm.bpe import encode  # noqa: E402
from paperloom.llm.contamination import drop_contaminated  # noqa: E402
from paperloom.llm.exact import drop_exact_copies  # noqa: E402
from paperloom.llm.jaccard import drop_near_copies  # noqa: E402
from paperloom.llm.quality import drop_low_quality  # noqa: E402
from paperloom.session import materialise  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on trusted text accepts; null and empty texts stay, an empty table stays empty."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z, the one with the largest id; null counts as empty, and of rows
    repeated with one id and text one stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by five-word shingles at 0.8.

    Texts without words are linked with nothing and stay; a long text is compared whole.
    """
    return drop_near_copies(docs, k=5, num=4, den=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten consecutive words of a benchmark item occur; texts without words stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the remaining documents as token ids, and the bytes these stand for.

    Null and empty texts have no tokens and decode to nothing; repeated rows are encoded alike.
    """
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE encoding and decoding", tokenise),
]

#: The quality model and the token merges have no SQL form; tests hold the other stages against brute
#: force, the model against brute force, and the tokens against what they decode to.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{number}")
    return docs
