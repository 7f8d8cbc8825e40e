"""Small documents with every awkward case, for the operators of the training-data package."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empties, ties, repeated rows, copies of growing distance, one long text."""
    rnd = random.Random(5)
    words = ["the", "of", "Ünder", "réal", "token", "x1", "42", "don't", "A-B", "zeta", "omega", "kappa", "i", "to"]

    def prose(n):
        return " ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))

    base = [prose(60) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "One"), (6, "one two three"), (7, base[0]),
            (8, base[0].upper()), (9, base[0] + " tail"), (10, base[0] + " tail"), (None, base[1]), (None, base[1]),
            (11, base[1]), (12, "For " * 300), (13, "for " * 299 + "End"), (14, base[2] + base[3]), (15, base[3] + base[2])]
    for i in range(16, 60):
        parts = rnd.choice(base).split(" ")
        for _ in range(rnd.randint(0, 4)):
            parts[rnd.randrange(len(parts))] = rnd.choice(words)
        rows.append((i, " ".join(parts)))
    rows += [(60, prose(3000)), (61, "😀 naïve 字 text \x00 with \x85 odd  bytes"), rows[6], rows[6], rows[20]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ("en", "fr", None)[n % 3], "src", None if t is None else len(t)) for n, (i, t) in enumerate(texts)]
    # Columns named like an operator's own results must not get in its way.
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns(
        {c: F.lit("clash") for c in ("n_shingles", "kept", "text_sha256", "ids", "n_words", "host", "bucket", "row_key")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
