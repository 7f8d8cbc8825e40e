"""Saved queries met by arriving passages."""

from __future__ import annotations

import numpy as np

from paperloom.operators import keyword as K
from paperloom.sources.versions import read_versions
from paperloom.streaming import percolate as P
from paperloom.streaming.jobs import stream_files
from test_metric_join import clusters


def tables(spark):
    rng = np.random.default_rng(21)
    both = clusters(rng, 900, groups=60, spread=0.1)
    both[:60] = both[0]  # many people save one question
    words = ["graph", "networks", "deep", "learning", "climate", "the", "running", "tests"]
    text = lambda n: " ".join(rng.choice(words, n))
    saved = [(q, int(rng.integers(0, 3)), both[q].tolist() if q % 7 else None, text(rng.integers(0, 4)) if q % 3 else None) for q in range(500)]
    new = [(c, int(rng.integers(0, 4)), both[500 + c].tolist() if c % 9 else None, text(rng.integers(0, 9))) for c in range(400)]
    return (spark.createDataFrame(saved, "query_id long, user_id long, embedding array<double>, text string"),
            spark.createDataFrame(new, "chunk_id long, user_id long, embedding array<double>, content string"), saved, new)


def expected(spark, saved, new, floor):
    stems = lambda texts: [set(r.t) for r in spark.createDataFrame([(t or "",) for t in texts], "x string").select(K.terms("x").alias("t")).collect()]
    asked, held = stems([s[3] for s in saved]), stems([n[3] for n in new])
    out = {}
    for (q, u, e, _), a in zip(saved, asked):
        for (c, v, x, _), h in zip(new, held):
            if u == v:
                near = None
                if e and x:
                    sim = float(np.dot(e, x) / np.linalg.norm(e) / np.linalg.norm(x))
                    near = round(sim, 6) if sim >= floor else None
                if near is not None or (a and a <= h):
                    out[(q, c)] = (near, bool(a and a <= h))
    return out


def test_same_alerts_with_few_pairs(spark, tmp_path):
    saved, new, s, n = tables(spark)
    P.store_saved(saved, str(tmp_path / "saved"), cell_rows=20)
    got = {(r.query_id, r.chunk_id): (None if r.similarity is None else round(r.similarity, 6), r.by_words)
           for r in P.alerts(spark, str(tmp_path / "saved"), new, 0.9).collect()}
    assert got == expected(spark, s, n, 0.9)
    pairs = P.vector_alerts(spark, str(tmp_path / "saved"), new, 0.9)[1].first()
    assert 0 < pairs["pairs"] < pairs["all_pairs"] / 2


def test_as_a_stream(spark, tmp_path):
    saved, new, s, n = tables(spark)
    P.store_saved(saved, str(tmp_path / "saved"), cell_rows=200)
    run = lambda: P.alert_stream(stream_files(spark, str(tmp_path / "in"), "*.parquet", new.schema), str(tmp_path / "saved"),
                                 str(tmp_path / "alerts"), str(tmp_path / "ck"), 0.9).awaitTermination()
    new.filter("chunk_id < 150").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    new.filter("chunk_id >= 150").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    got = {(r.query_id, r.chunk_id) for r in read_versions(spark, str(tmp_path / "alerts"), "chunk_id").collect()}
    assert got == expected(spark, s, n, 0.9).keys()
