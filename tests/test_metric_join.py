"""Cells around pivots against all pairs."""

from __future__ import annotations

import math

import numpy as np

from paperloom.operators import metric_join as M


def clusters(rng, n, dim=12, groups=30, spread=0.08):
    centres = rng.normal(size=(groups, dim))
    rows = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * spread
    return rows.astype("float32")


def frame(spark, vectors, owners):
    rows = [(i, int(owners[i]), i // 2, 1000 - i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(len(rows), 0, len(rows), 5, None), (len(rows) + 1, 0, len(rows), 5, [0.0] * vectors.shape[1])]
    return spark.createDataFrame(rows, "chunk_id long, user_id long, paper_id long, arrival long, embedding array<float>")


def brute(vectors, owners, least, timed=False):
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sims = unit @ unit.T
    n = np.arange(len(vectors))
    ok = (owners[:, None] == owners[None]) & (n[:, None] // 2 != n[None] // 2) & (sims >= least)
    if timed:
        ok &= n[None] > n[:, None]  # earlier arrivals have larger numbers
    return {i: round(float(sims[i][ok[i]].max()), 9) for i in n if ok[i].any()}


def probes_of(df, timed=False):
    names = ["chunk_id AS probe_id", "user_id", "embedding", "paper_id AS skip_paper"] + (["arrival AS before"] if timed else [])
    return df.selectExpr(*names)


def test_equal_to_all_pairs_with_bounded_cells(spark):
    rng = np.random.default_rng(5)
    vectors = clusters(rng, 1200)
    vectors[200:500] = vectors[200]  # no pivot splits equal vectors
    owners = np.where(rng.random(1200) < 0.5, 0, rng.integers(1, 4, 1200))
    df = frame(spark, vectors, owners)
    for least in (0.92, 0.3):
        got = {r.probe_id: round(r.similarity, 9) for r in M.nearest_within(df, probes_of(df), least, cell_rows=60, fan=6).collect()}
        want = brute(vectors, owners, least)
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-8) for i in got)
    cells, asked = M.deal(df.filter("chunk_id < 1200"), probes_of(df.filter("chunk_id < 1200")), 0.92, cell_rows=60, fan=6)
    sizes = M.cell_sizes(cells, asked).collect()
    assert cells.count() == 1200 and max(r.n_candidates for r in sizes) <= 60
    everything = sum(int((owners == o).sum()) ** 2 for o in range(4))
    assert sum(r.n_candidates * r.n_probes for r in sizes) < everything / 2


def test_only_earlier_ones(spark):
    rng = np.random.default_rng(6)
    vectors, owners = clusters(rng, 300), np.zeros(300, int)
    df = frame(spark, vectors, owners)
    got = {r.probe_id: round(r.similarity, 6) for r in M.nearest_within(df, probes_of(df, True), 0.9, cell_rows=50).collect()}
    assert got == {i: round(s, 6) for i, s in brute(vectors, owners, 0.9, timed=True).items()}


def test_ties_and_empty(spark):
    df = spark.createDataFrame([(i, 1, i, 0, [1.0, 2.0]) for i in (7, 3, 9)],
                               "chunk_id long, user_id long, paper_id long, arrival long, embedding array<float>")
    got = {r.probe_id: r.chunk_id for r in M.nearest_within(df, probes_of(df), 0.9, cell_rows=1).collect()}
    assert got == {3: 7, 7: 3, 9: 3}
    none = df.filter("false")
    assert M.nearest_within(none, probes_of(none), 0.9).collect() == []


def test_a_split_that_keeps_nothing_apart_copies_no_probe(spark, monkeypatch):
    """Vectors all around a sphere at a wide angle: every probe would go to every cell."""
    rng = np.random.default_rng(8)
    vectors, owners = rng.normal(size=(900, 12)).astype("float32"), np.zeros(900, int)
    vectors[500:520] = vectors[40]
    df = frame(spark, vectors, owners)
    cells, asked = M.deal(df.filter("chunk_id < 900"), probes_of(df.filter("chunk_id < 900")), 0.1, cell_rows=60, fan=6, gain=M.GAIN)
    assert cells.count() == 900 and asked.count() == 900
    monkeypatch.setattr(M, "BLOCK_ROWS", 100)
    monkeypatch.setattr(M, "SLICE_SCORES", 1_000)
    got = {r.probe_id: r for r in M.nearest_within(df, probes_of(df), 0.1, cell_rows=60, fan=6).collect()}
    want = brute(vectors, owners, 0.1)
    assert got.keys() == want.keys() and all(math.isclose(got[i].similarity, want[i], abs_tol=1e-8) for i in got)
    assert {got[i].chunk_id for i in range(500, 520)} == {40}
