from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from paperloom.llm import quality
from paperloom.llm.quality import ORDER, PAD, classify_quality, drop_low_quality, kneser_ney, pack, score, train_counts
from pyspark.sql import functions as F


def brute_model(train):
    """Interpolated modified Kneser-Ney by dictionaries."""
    counts = {ORDER: Counter()}
    for t in train:
        t = PAD * (ORDER - 1) + t
        counts[ORDER].update(t[i : i + ORDER] for i in range(len(t) - ORDER + 1))
    for k in range(ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, context = {}, {}
    for k, c in counts.items():
        n = [sum(v == j for v in c.values()) for j in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        discount[k] = [min(j, max(0.0, j - (j + 1) * y * n[j] / n[j - 1])) if n[j - 1] else j / 2 for j in (1, 2, 3)]
        context[k] = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            context[k][g[:-1]][0] += v
            context[k][g[:-1]][1] += discount[k][min(v, 3) - 1]

    def p(gram):
        k = len(gram)
        low = p(gram[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        if gram[:-1] not in context[k]:
            return low
        total, lost = context[k][gram[:-1]]
        v = counts[k].get(gram, 0)
        return (v - discount[k][min(v, 3) - 1] if v else 0.0) / total + lost / total * low

    def nats(t):
        t = PAD * (ORDER - 1) + t
        return -sum(math.log(p(t[i : i + ORDER])) for i in range(len(t) - ORDER + 1))

    return nats


def test_scores_against_brute_force(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(quality, "STEP_CHARS", 5000)
    good = sorted({i for i, _ in texts if i is not None and i % 3 == 0})
    trusted = spark.createDataFrame([(i,) for i in good], "doc_id long").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int"))
    packed = pack(docs, 5, "doc_id", "text", "lang")
    model, unseen = kneser_ney(train_counts(packed, trusted))
    got = {(r.doc_id, r.n_chars, round(r.nats, 2)) for r in score(packed, model, unseen, 5, "bigint").collect()}
    nats = brute_model([t or "" for i, t in texts if i in good])
    expected = {(i, len(t or ""), nats(t or "")) for i, t in texts}
    for i, n, value in expected:
        assert any(j == i and m == n and abs(v - value) <= 0.02 + 2e-5 * abs(value) for j, m, v in got), (i, n, value)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(9)
    syllables = ["an", "er", "th", "on", "in", "es", "re", "ti", "or", "ble", "ing", "ou"]

    def clean(n):
        return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(n)).capitalize() + "."

    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        text = clean(rnd.randint(20, 120))
        if bad:
            text = " ".join(w + rnd.choice(["***", "%%%", "###", "&&&"]) for w in text.split()) if i % 16 else text.upper()
        rows.append((i, text, "xx" if i % 3 else "yy"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_keeps_clean_and_rejects_junk_not_seen_in_training(corpus):
    docs, labels = corpus
    judged = {r.doc_id: r for r in classify_quality(docs, labels).collect()}
    bad = [judged[i].keep for i in range(400) if i % 8 == 0]
    good = [judged[i].keep for i in range(400) if i % 8]
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.98 * len(good)
    kept = drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(bad) + sum(good)


def test_awkward_rows_and_empty_tables(spark, docs, empty, texts, corpus):
    labels = corpus[1]
    judged = classify_quality(docs, labels)
    rows = judged.collect()
    assert len(rows) == len(texts)
    assert all(r.keep and r.perplexity is None for r in rows if r.n_chars == 0)
    assert classify_quality(empty, labels).collect() == []
    assert all(r.keep for r in classify_quality(docs, labels.filter("false")).collect())


def test_loops_of_likely_words_and_foreign_words_in_long_texts(spark, corpus):
    docs, labels = corpus
    good = [r.text for r in docs.filter("doc_id % 8 = 1").orderBy("doc_id").limit(40).collect()]
    word = max((w for t in good for w in t.split()), key=len)
    rows = [(1000, f"{word} " * 300), (1001, f"{good[0]} " + f"{word} " * 80 + " ".join(good[1:9])),
            (1002, " ".join(good[:30]) + " qwjxvkzq mfgkqwyp " + " ".join(good[:10])), (1003, None), (1004, "")]
    judged = {r.doc_id: r for r in classify_quality(
        docs.union(spark.createDataFrame([(*r, "xx") for r in rows], docs.schema)), labels).collect()}
    for i in (1000, 1001, 1002):
        assert judged[i].score <= judged[i].threshold, i
    assert [judged[i].keep for i in range(1000, 1005)] == [False, False, False, True, True]


def test_extremes_against_brute_force():
    rnd = random.Random(3)
    sizes = [0, 5, 700, 0, 40, 31]
    grams = [[rnd.randrange(40) for _ in range(n)] for n in sizes]
    nats = [[rnd.random() for _ in g] for g in grams]
    peak, fresh = quality.extremes(np.array(sum(nats, [])), np.array(sum(grams, [])), np.array(sizes), np.zeros(0))
    w, b = quality.PEAK_CHARS, quality.BLOCK_CHARS
    for i, n in enumerate(sizes):
        assert peak[i] == pytest.approx(max([sum(nats[i][max(0, e - w) : e]) / w for e in range(1, n + 1)], default=0))
        blocks = [grams[i][a : a + b] for a in range(0, n, b)]
        assert fresh[i] == min([len(set(x)) / len(x) for x in blocks if len(x) >= quality.LEAST_BLOCK], default=1)
