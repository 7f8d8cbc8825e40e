from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from paperloom.llm.exact import chunks, drop_exact_copies, exact_groups


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[lower(t)].append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i, n in Counter(ids).items():
            out[(i, keep, len(ids), i == keep, sha)] += 1
            if n > 1:
                out[(i, keep, len(ids), False, sha)] += n - 1
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_against_brute_force(docs, texts):
    assert rows(exact_groups(docs)) == brute(texts)


def test_same_result_when_chunk_identifiers_collide(docs, texts):
    """With a bad identifier most chunks are contested, and whole texts decide."""
    bad = exact_groups(docs, chunk_id=lambda c: F.length(c).cast("long") % 3)
    assert rows(bad) == brute(texts)


def test_chunks_join_to_the_text_and_realign(spark):
    rnd = random.Random(1)
    body = " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(4000))
    df = spark.createDataFrame([(body,), ("Inserted first. " + body,), ("x" * 20000,), ("",)], "text string")
    got = [r[0] for r in df.select(chunks(F.col("text"))).collect()]
    assert ["".join(c) for c in got] == [body, "Inserted first. " + body, "x" * 20000, ""]
    assert len(got[0]) > 20 and len(set(got[0]) & set(got[1])) >= len(got[0]) - 3
    assert max(map(len, got[2])) == 8192


def test_empty_table_and_filter(docs, empty, texts):
    assert exact_groups(empty).collect() == [] and drop_exact_copies(empty).collect() == []
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    expected = Counter()
    for (i, _, _, keep, _), n in brute(texts).items():
        expected[i] += n * keep
    assert Counter(r.doc_id for r in kept.collect()) == +expected


def test_no_python_in_the_plan(docs):
    plan = exact_groups(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
