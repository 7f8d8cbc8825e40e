"""Spherical-cap filters against all pairs."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import caps

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, least=0.93):
    kept = [(n, l, np.array(e, float)) for n, (i, e, l) in enumerate(rows)
            if i is not None and l is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    links, root = collections.Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (n, l, x) in enumerate(kept):
        for m, k, y in kept[:a]:
            if l == k and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[n] += 1
                links[m] += 1
                root[max(find(n), find(m))] = min(find(n), find(m))
    smallest = {}
    for n, (i, _, _) in enumerate(rows):
        r = find(n)
        smallest[r] = i if r not in smallest else min(smallest[r], i)
    return collections.Counter((i, links[n], smallest[find(n)], i is None or i == smallest[find(n)]) for n, (i, _, _) in enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for spread, n in ((0.0, 30), (0.02, 60), (0.05, 60), (0.07, 40), (1.0, 60)):
        centre = rng.normal(size=20) / np.sqrt(20)
        out += [(len(out) + i, (centre + rng.normal(size=20) * spread).tolist(), int(rng.integers(0, 2))) for i in range(n)]
    big = (rng.normal(size=20) * 1e200).tolist()
    out += [(900, None, 1), (901, [], 1), (902, [0.0] * 20, 1), (903, [1.0] * 19 + [None], 1), (904, [float("nan")] * 20, 1),
            (905, [float("inf")] + [1.0] * 19, 1), (906, out[3][1], None), (None, out[3][1], out[3][2]), (907, big, 0), (908, big, 0),
            (909, [1.0, 2.0], 0), (910, [2.0, 4.0], 0), (911, [5.0], 0), (912, [2.0], 0), (913, [-2.0], 0)]
    out += [(3, out[3][1], out[3][2])]  # a repeated row is a vector of its own
    return out


def test_equal_to_all_pairs(spark, rows):
    clash = {c: F.lit("clash") for c in ("key", "ball", "uid", "n_links", "kept", "cell", "component_id")}
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns(clash)
    small = [r for r in rows if r[0] not in (907, 908)]  # whose squares overflow in the model
    got = collections.Counter(tuple(r) for r in caps.vector_groups(df.filter("vec_id is null or vec_id not in (907, 908)")).collect())
    want = brute(small)
    found, true = sum(r[1] * n for r, n in got.items()), sum(r[1] * n for r, n in want.items())
    assert found <= true and found >= 0.995 * true
    assert {r[0]: r[1] for r in got if r[0] and r[0] >= 900} == {r[0]: r[1] for r in want if r[0] and r[0] >= 900}


def test_overflow_and_empty(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    two = caps.vector_groups(df.filter("vec_id in (907, 908)")).collect()
    assert sorted(map(tuple, two)) == [(907, 1, 907, True), (908, 1, 907, False)]
    assert caps.vector_groups(df.filter("false")).collect() == []


def test_decode_lists_every_exceeded_filter():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    words, limit = 5, 0.35
    turn, books = caps._code(10, words, 0)
    turned = x @ turn
    width = turned.shape[1] // caps.PARTS
    gains = [turned[:, i * width : (i + 1) * width] @ books[i] for i in range(caps.PARTS)]
    want = set()
    for i in range(20):
        for digits in np.ndindex(*[words] * caps.PARTS):
            if sum(gains[p][i, d] for p, d in enumerate(digits)) >= limit:
                number = 0
                for d in digits:
                    number = number * words + d
                want.add((i, number * caps.CODES))
    row, name = caps.decode(x, words, limit, 0)
    assert set(zip(row.tolist(), name.tolist())) == want and len(row) == len(want)


def test_recall_on_planted_pairs(spark):
    """Pairs right above the limit, where filters are least sure to meet."""
    rng = np.random.default_rng(9)
    rows = []
    for p in range(400):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        y = rng.normal(size=64)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.931 + 0.02 * rng.random()
        rows += [(2 * p, x.tolist(), 0), (2 * p + 1, (c * x + np.sqrt(1 - c * c) * y).tolist(), 0)]
    got = caps.vector_groups(spark.createDataFrame(rows, SCHEMA)).agg(F.sum("n_links")).first()[0]
    assert got >= 0.97 * 800
