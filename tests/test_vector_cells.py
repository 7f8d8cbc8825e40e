"""Stored cells against the scan of all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from paperloom.operators import vector_cells as V
from paperloom.operators.vector_search import nearest
from test_metric_join import clusters


def table(spark, n=1500):
    rng = np.random.default_rng(11)
    vectors = clusters(rng, n, groups=40, spread=0.1)
    vectors[300:420] = vectors[300]  # equal vectors, more than a cell holds
    rows = [(i, 0 if i % 3 else i % 4, ["results", "abstract"][i % 2], i // 3, 2000 + i % 7, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(n, 0, "results", n, 2000, None), (n + 1, 0, "results", n, 2000, [0.0] * 12)]
    return vectors, spark.createDataFrame(
        rows, "chunk_id int, user_id int, section_type string, paper_id int, publication_year int, embedding array<float>")


def test_same_rows_as_a_scan(spark, tmp_path):
    vectors, pool = table(spark)
    V.store_cells(pool, str(tmp_path / "cells"), cell_rows=50, slots=4)
    rng = np.random.default_rng(12)
    near = vectors[rng.integers(0, len(vectors), 30)] + rng.normal(size=(30, 12)) * 0.05
    probes = [(q, q % 5, [3, 8, 40][q % 3], ["results"] if q % 2 else [], 2003 if q % 4 == 1 else None, near[q].tolist()) for q in range(30)]
    probes = spark.createDataFrame(
        probes, "probe_id int, user_id int, top_k int, sections array<string>, want_year int, embedding array<double>")
    show = lambda df: {(r.probe_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect()}
    got, report = V.search_cells(spark, str(tmp_path / "cells"), probes)
    assert show(got) == show(nearest(pool.filter(F.col("embedding").isNotNull()), probes))
    # Few of the clusters are near to a probe: less than half of the cells is read.
    plain, report = V.search_cells(spark, str(tmp_path / "cells"), probes.drop("sections", "want_year"))
    assert show(plain) == show(nearest(pool.filter(F.col("embedding").isNotNull()), probes.drop("sections", "want_year")))
    read = report.agg(F.sum("read").alias("read"), F.sum("cells").alias("cells")).first()
    assert read["read"] < read["cells"] / 2
    sizes = spark.read.parquet(str(tmp_path / "cells" / "caps")).agg(F.max("n"), F.sum("n")).first()
    assert sizes[0] <= 50 and sizes[1] == len(vectors)


def test_fewer_rows_than_asked_and_nothing_stored(spark, tmp_path):
    _, pool = table(spark, 450)
    few = pool.filter("chunk_id < 5")
    probes = spark.createDataFrame([(1, 0, 9, [1.0] * 12), (2, 77, 9, [1.0] * 12), (3, 0, 9, None)],
                                   "probe_id int, user_id int, top_k int, embedding array<double>")
    V.store_cells(few, str(tmp_path / "few"), cell_rows=2)
    got, _ = V.search_cells(spark, str(tmp_path / "few"), probes)
    want = nearest(few, probes.filter("embedding IS NOT NULL"))
    assert sorted(map(tuple, got.select("probe_id", "chunk_id", "rank").collect())) == sorted(
        map(tuple, want.select("probe_id", "chunk_id", "rank").collect()))
