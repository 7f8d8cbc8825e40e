from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import jaccard
from paperloom.llm.jaccard import drop_near_copies, jaccard_groups, signatures
from paperloom.llm.graph import components


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, k, num, den):
    sets = [shingles(t, k) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    smallest = {}
    for n, (i, _) in enumerate(texts):
        if i is not None:
            smallest[find(n)] = min(i, smallest.get(find(n), i))
    return Counter((i, len(s), smallest.get(find(n)) if s else i) for n, ((i, _), s) in enumerate(zip(texts, sets)))


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 4, 5), (2, 1, 2), (1, 3, 10)])
def test_against_brute_force(docs, texts, k, num, den):
    assert found(jaccard_groups(docs, k, num, den)) == brute(texts, k, num, den)


def test_token_combinations_lose_no_link(spark, monkeypatch):
    """All tokens are made frequent ones: pairs and triples alone must find every link."""
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(words) for _ in range(120)] for _ in range(3)]
    rows = []
    for i in range(150):
        text = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 12)):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for limits in ((0, 10**9), (0, 0), (3, 20)):
        monkeypatch.setattr(jaccard, "CLASS_LIMITS", limits)
        assert found(jaccard_groups(df, 2, 4, 5)) == brute(rows, 2, 4, 5)


def test_signatures_of_linked_sets_meet():
    rnd = np.random.default_rng(4)
    often = {t: int(rnd.integers(2, 400)) for t in range(2000)}
    for _ in range(400):
        n = int(rnd.integers(6, 400))
        a = set(rnd.choice(2000, n, replace=False).tolist())
        b = set(a)
        for t in rnd.choice(sorted(a), int(n * rnd.random() * 0.12), replace=False).tolist():
            b.discard(t)
            if rnd.random() < 0.5:
                b.add(int(rnd.integers(0, 2000)))
        if 100 * len(a & b) < 85 * len(a | b):
            continue
        marks = []
        for s in (a, b):
            token = np.array(sorted(s, key=lambda t: (often[t], t)), np.uint64)
            marks.append(set(signatures(token, np.array([often[int(t)] for t in token]), len(s), 85, 100).tolist()))
        assert marks[0] & marks[1]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_empty_table_and_filter(docs, empty, texts):
    assert jaccard_groups(empty).collect() == [] and drop_near_copies(empty).collect() == []
    kept = drop_near_copies(docs, 4, 85, 100)
    assert kept.columns == docs.columns
    expected = Counter(i for (i, _, c) in brute(texts, 4, 85, 100) if i == c)
    assert Counter(r.doc_id for r in kept.collect()) == expected
