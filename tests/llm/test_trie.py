"""The conversation trie against a plain one."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm.ranking import list_rank
from paperloom.llm.scans import sorted_scan
from paperloom.llm.trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append((t is not None, t or 0, role, tie, text))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(k))
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [(None, 0, "user", "nobody's"), (None, None, None, None)]
    for c in range(0, 340):
        if c == 100:
            continue  # a block without its first conversation
        n = 60 if c == 7 else rnd.randint(1, 5)  # one conversation holds many rows
        for t in range(n):
            out.append((c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None]),
                        rnd.choice(["a", "b", "", None, "é字", "longer text " * 40])))
    out += [out[40]] * 2 + [(9, 1, "user", "tie"), (9, 1, "user", "tie2"), (9, 1, "a", "tie")]
    return out


def test_equal_to_a_plain_trie(spark, rows):
    clash = {c: F.lit("clash") for c in ("node", "depth", "parent", "n_convs", "a", "pos", "part_")}
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns(clash)
    got = sorted((tuple(r) for r in conversation_trie(df, last=100).collect()), key=str)
    assert got == brute(rows)


def test_small_and_empty(spark):
    df = spark.createDataFrame([(5, 1, "user", "x")], SCHEMA)
    assert sorted(map(tuple, conversation_trie(df).collect()), key=str) == brute([(5, 1, "user", "x")])
    assert conversation_trie(df.filter("false")).collect() == []
    assert conversation_trie(df.withColumn("conv_id", F.lit(None).cast("long"))).collect() == []


def test_list_rank(spark):
    order = list(range(500))
    random.Random(1).shuffle(order)
    rows = [(a, order[i - 1] if i else None, order[i + 1] if i < 499 else None) for i, a in enumerate(order)]
    arcs = spark.createDataFrame(rows, "a long, pred long, succ long")
    for last in (1000, 40):
        assert {r.a: r.pos for r in list_rank(arcs, last).collect()} == {a: i for i, a in enumerate(order)}
    assert list_rank(arcs.filter("false")).collect() == []


def test_scan_over_many_tasks(spark):
    rnd = random.Random(2)
    keys = [rnd.choice([1, 1, 1, 2, 3]) for _ in range(900)]
    df = spark.createDataFrame([(k, i, rnd.randint(0, 9)) for i, k in enumerate(keys)], "k long, o long, v long").repartition(7)
    got = sorted(tuple(r) for r in sorted_scan(df, "k", ["o"], ["v"], item="o").collect())
    want, by_key = [], collections.defaultdict(list)
    for k, o, v in sorted(tuple(r) for r in df.collect()):
        by_key[k].append((o, v))
    for k, rows in by_key.items():
        total = 0
        for i, (o, v) in enumerate(rows):
            total += v
            want.append((k, o, v, total, rows[i - 1][0] if i else None, rows[i + 1][0] if i + 1 < len(rows) else None))
    assert got == sorted(want)
