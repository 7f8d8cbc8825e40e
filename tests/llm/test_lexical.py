"""Ranked search against scoring every document."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import lexical

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return TERM.findall(raw)


def brute(docs, items, k):
    docs = [(i, collections.Counter(words(t))) for i, t in docs if words(t)]
    n_docs, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(w for _, c in docs for w in c)
    out = []
    for item, text in items:
        asked, rows = collections.Counter(words(text)), []
        for i, c in docs:
            m = 25 + (75 * sum(c.values()) * n_docs) // length
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (
                (1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w, n in asked.items() if w in c)
            if score > 0:
                rows.append((-score, i is not None, i or 0))
        out += [(item, n + 1, i if has else None, -s) for n, (s, has, i) in enumerate(sorted(rows)[:k])]
    return collections.Counter(out)


@pytest.fixture(scope="module")
def items():
    return [("a", "the token of Ünder 42"), ("b", "zeta kappa, zeta. ZETA one"), ("c", None), ("d", "..."), ("e", "nothing-matches qqq"),
            ("f", "naïve 字 text omega don't i to the of"), ("a", "kappa"), (None, "réal x1"), ("g", " ".join(["the", "omega", "x1"] * 50))]


@pytest.mark.parametrize("query_bytes", [1 << 18, 40])
def test_equal_to_scoring_all(spark, docs, texts, items, query_bytes, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    asked = spark.createDataFrame(items, "item_id string, text string").withColumn("rank", F.lit("clash"))
    more = docs.withColumns({c: F.lit("clash") for c in ("n", "terms", "code", "item", "score")})
    for k in (3, 10):
        got = collections.Counter(tuple(r) for r in lexical.rank_documents(more, asked, k, query_bytes).collect())
        assert got == brute([(i, t) for i, t in texts], items, k)


def test_empty_tables(spark, docs, empty, items):
    asked = spark.createDataFrame(items, "item_id string, text string")
    assert lexical.rank_documents(empty, asked).collect() == []
    assert lexical.rank_documents(docs, asked.filter("false")).collect() == []
    assert lexical.rank_documents(docs.filter("text is null"), asked).collect() == []


def test_blocks_are_skipped_by_their_bounds():
    """A chunk of which few documents matter: most blocks are not looked into, and the best are those of all scores."""
    rng = np.random.default_rng(1)
    n, terms = 640, 12
    values = np.sort(rng.integers(1, 1000, n)).astype("<i4")
    grid = np.stack([np.where(rng.random(n) < 0.7, values // (t + 1) + 1, 0) for t in range(terms)], 1).astype("<i4")
    lists, word, end, size, at, top = [], [], [], [], [], []
    for t in range(terms):
        mine = np.flatnonzero(grid[:, t])
        for a in range(0, len(mine), 32):
            block = mine[a : a + 32]
            best = grid[block, t:].max(0)
            lists.append(block)
            word.append(t)
            end.append(sum(map(len, lists)))
            size.append(np.count_nonzero(best))
            at.append(t + np.flatnonzero(best))
            top.append(best[best > 0])
    held = grid > 0
    i4 = lambda x: np.asarray(x, "<i4").tobytes()
    chunk = lexical._Chunk({
        "ids": np.arange(n, dtype="<i8").tobytes(), "no_id": bytes(n), "sizes": i4(held.sum(1)), "terms": i4(np.nonzero(held)[1]),
        "vals": i4(grid[held]), "lists": i4(np.concatenate(lists)), "block_word": i4(word), "block_end": i4(end),
        "summary_size": i4(size), "summary_word": i4(np.concatenate(at)), "summary": i4(np.concatenate(top))})
    factor, counts = np.arange(terms, 0, -1), np.zeros(2, np.int64)
    got = chunk.best(np.arange(terms), factor, 10, 0, counts)
    scores = grid.astype(np.int64) @ factor
    assert sorted(-s for s, _, _ in got)[:10] == sorted(-scores)[:10]
    assert counts[1] < counts[0] / 4
