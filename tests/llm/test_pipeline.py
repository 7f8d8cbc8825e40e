from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from oracle import compare, connect
from paperloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    rows, _, verdict = compare(spark, duck, FOLDER, QUERIES[name], SQL.get(name))
    assert rows > 0 and verdict == ("ok" if name in SQL else "rows only")


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_stages_one_after_the_other(spark):
    """Each stage does to its input what its operator says, and run() is all of them."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert after.items() <= before.items() and docs.count() == len(after)
        ids.append((name, before, after))
    exact = ids[1]
    groups = {}
    for i, t in exact[1].items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        groups[low] = max(i, groups.get(low, i))
    assert set(exact[2]) == set(groups.values())
    # Near copies: one document, the smallest id, of each group linked by 4/5 of its five-word shingles.
    before, after = ids[2][1], ids[2][2]
    sets = {}
    for i, t in before.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        ws = [w for w in re.split("[ \t-\r]+", low) if w]
        sets[i] = {tuple(ws[j : j + 5]) for j in range(max(1, len(ws) - 4))} if ws else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert set(after) == {i for i in sets if find(i) == i}
    # Decontamination: ten words of an item, or all of a shorter one.
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {tuple(w[j : j + 10]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
               for w in [cut(r.text)] if w for j in range(max(1, len(w) - 9))}
    lengths = {len(w) for w in windows}

    def dirty(t):
        w = cut(t)
        return any(tuple(w[j : j + n]) in windows for n in lengths for j in range(len(w) - n + 1))

    assert set(ids[3][2]) == {i for i, t in ids[3][1].items() if not dirty(t)}
    coded = corpus_pipeline.run(spark, FOLDER).collect()
    assert all(bytes(r.decoded).decode() == (ids[-1][2][r.doc_id] or "") for r in coded)
    tokens = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in coded}
    assert set(tokens) == set(ids[-1][2])


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).collect() == []


def test_stages_leave_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("length(text) < 2000")
    names = ["_id", "_key", "_text_key", "_sha2", "_sha", "text_key", "gone_id", "kept_id", "hit_id", "copies", "keep", "n_hit"]
    wide = docs.withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, FOLDER)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[n] == n for r in rows for n in names), name
