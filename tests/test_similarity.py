"""Similarity operators against brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from paperloom.functions.trigrams import jaccard, trigrams
from paperloom.operators import duplicates as D
from paperloom.operators import retrieval as R
from paperloom.operators.vector_search import nearest

RNG = np.random.default_rng(3)


def test_trigram_value(spark):
    r = spark.range(1).select(jaccard(trigrams(F.lit("word")), trigrams(F.lit("two words"))).alias("s")).first()["s"]
    assert round(r, 4) == 0.3636


def py_grams(title):
    import re

    return {f"  {w} "[i : i + 3] for w in re.findall(r"\w+", title.lower()) for i in range(len(w) + 1)}


def test_similar_titles(spark):
    rng = random.Random(4)
    base = ["neural graph search methods", "deep retrieval of long documents", "a survey of climate data", "quantum error codes"]
    rows = []
    for n in range(160):
        words = rng.choice(base).split()
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] += rng.choice(["s", "x", "ing", " v2"])
        # A third of all rows is one title of one user.
        rows.append((n, 0 if n % 3 == 0 else n % 4, base[0] if n % 3 == 0 else " ".join(words)))
    lib = spark.createDataFrame(rows, "paper_id int, user_id int, title string")
    for posting_rows in (5_000, 3):
        got = {r.probe_id: (r.similar_to, round(r.similarity, 6)) for r in D.similar_titles(lib.withColumnRenamed("paper_id", "probe_id"), lib, posting_rows=posting_rows).collect()}
        want = {}
        for i, u, t in rows:
            best = None
            for j, v, o in rows:
                if i != j and u == v:
                    a, b = py_grams(t), py_grams(o)
                    s = len(a & b) / len(a | b)
                    if s >= 0.72 and (best is None or (-s, j) < best):
                        best = (-s, j)
            if best:
                want[i] = (best[1], round(-best[0], 6))
        assert got == want


def test_titles_of_one_vocabulary_give_few_candidates(spark):
    # Every title shares its trigrams with most others, so an index of single trigrams keeps nobody apart.
    rng = random.Random(8)
    parts = ["er", "on", "ing", "th", "ed", "le", "an", "st"]
    titles = {n: " ".join("".join(rng.choices(parts, k=3)) for _ in range(12)) for n in range(400)}
    titles |= {n + 400: titles[n] + " v2" for n in range(40)}
    rows = spark.createDataFrame(list(titles.items()), "id int, title string").withColumn("user_id", F.lit(1))
    sets = rows.select("user_id", D.trigrams(F.col("title")).alias("grams")).select(
        "user_id", D._set_id().alias("set_id"), F.lit(True).alias("is_lib"), F.lit(True).alias("is_ask"), F.size("grams").alias("n"), "grams")
    grams = {i: py_grams(t) for i, t in titles.items()}
    close = sum(100 * len(grams[a] & grams[b]) >= 72 * len(grams[a] | grams[b]) for a in grams for b in grams if a != b)
    for block_rows in (5_000, 60):
        found = D._candidates(D._parities(sets), 0.72, block_rows)
        n = found.count()
        assert n == found.distinct().count() and 80 <= close <= n <= 3 * close


def vectors(n, dim=8):
    v = RNG.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")


def test_nearest_forms_agree(spark):
    vs, qs = vectors(300), vectors(24)
    labels = ["abstract", "results", "other"]
    cand = [(i, 0 if i % 3 else i % 4, labels[i % 3], i // 3, vs[i].tolist()) for i in range(300)]
    probes = [(q, q % 4, 5, ["results"] if q % 2 else [], q // 4, qs[q].tolist()) for q in range(24)]
    c = spark.createDataFrame(cand, "chunk_id int, user_id int, section_type string, paper_id int, embedding array<float>")
    p = spark.createDataFrame(probes, "probe_id int, user_id int, top_k int, sections array<string>, skip_paper int, embedding array<float>")
    want = set()
    for q, u, k, boost, skip, e in probes:
        rows = []
        for i, v, s, paper, x in cand:
            if v == u and paper != skip:
                sim = float(np.dot(np.float64(x), np.float64(e)) / np.linalg.norm(np.float64(x)) / np.linalg.norm(np.float64(e)))
                rows.append((-sim * (1.25 if s in boost else 1), i))
        want |= {(q, i, n + 1) for n, (_, i) in enumerate(sorted(rows)[:k])}
    for options in ({}, {"broadcast_bytes": 0, "block_rows": 20}):
        got = {(r.probe_id, r.chunk_id, r["rank"]) for r in nearest(c, p, **options).collect()}
        assert got == want


def test_opening_duplicates(spark):
    vs = vectors(40, 16)
    rows, papers = [], []
    for n in range(40):
        papers.append((n, n % 2, 1000 + n))
        rows += [(n, 0, vs[n].tolist()), (n, 1, vectors(1, 16)[0].tolist())]
    copy = vs[4] + RNG.normal(size=16) * 0.03
    rows += [(40, 0, copy.tolist()), (41, 0, vs[5].tolist())]
    papers += [(40, 0, 5000), (41, 0, 5001)]  # 41 copies a paper of the other user
    chunks = spark.createDataFrame([(p, p, i, e) for p, i, e in rows], "user_id int, paper_id int, chunk_index int, embedding array<float>")
    lib = spark.createDataFrame(papers, "paper_id int, user_id int, created_at int")
    got = {r.paper_id: r.duplicate_of for r in D.opening_duplicates(chunks, lib).collect()}
    assert got == {4: 40, 40: 4}
    assert {r.paper_id: r.duplicate_of for r in D.opening_duplicates(chunks, lib, mode="earlier").collect()} == {40: 4}


def test_merge_catalogue(spark):
    rows = [("W0", "SimCSE", 4200, 0), ("W1", "simcse!", 150, 1), ("W2", "Attention Is All You Need", 700, 2),
            ("W3", "Attention is all you need!", 90000, 3), ("W4", None, 1, 4), ("W5", None, 1, 5), ("W6", "SBERT", None, 6), ("W7", "sbert", 0, 7)]
    df = spark.createDataFrame(rows, "external_id string, title string, cited_by_count int, position int")
    got = [r.external_id for r in D.merge_catalogue(df).orderBy("first_position").collect()]
    assert got == ["W0", "W3", "W4", "W5", "W6"]


def close(a, b):
    short, long = sorted((a, b), key=len)
    return a == b or (len(short) > 80 and short[:120] == long[:120])


def test_near_identical_matches_greedy(spark):
    rng = random.Random(8)
    stems = ["ab cd " * k for k in (5, 13, 14, 20, 25, 40)]
    rows = [(q, n + 1, rng.choice(stems)[: rng.choice([60, 80, 81, 100, 119, 120, 121, 200, 230])] + rng.choice(["", "x", " Y  y"])) for q in range(40) for n in range(12)]
    df = spark.createDataFrame(rows, "query_id int, rank int, content string")
    got = {(r.query_id, r["rank"]) for r in R.drop_near_identical(df).collect()}
    want = set()
    for q in range(40):
        seen = []
        for _, n, text in sorted(r for r in rows if r[0] == q):
            mark = " ".join(text.lower().split())[:220]
            if not any(close(mark, s) for s in seen):
                seen.append(mark)
                want.add((q, n))
    assert got == want


def test_encoder_seam(spark):
    df = spark.createDataFrame([(n, f"text {n}") for n in range(5)], "id int, content string")
    got = R.encode_with(df, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert {tuple(r.embedding) for r in got} == {(6.0, 1.0)}
