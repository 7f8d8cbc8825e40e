from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import repeats
from paperloom.llm.repeats import find_repeats


def brute(rows, size):
    where = Counter()
    for _, t in rows:
        b = (t or "").encode()
        where.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if where[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out[(d, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))] += 1
    return out


def found(df, size):
    rows = find_repeats(df, size).collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed == r.n_bytes - len(r.kept)
    return Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in rows)


@pytest.mark.parametrize("size", [16, 40, 120])
def test_against_brute_force(docs, texts, size):
    assert found(docs, size) == brute(texts, size)


@pytest.mark.parametrize("probes, flush", [(1, 50), (8, 1 << 20)])
def test_overlaps_periods_and_common_passages(spark, monkeypatch, probes, flush):
    """Also when tasks send almost nothing of a common string and flush all the time."""
    monkeypatch.setattr(repeats, "PROBES", probes)
    monkeypatch.setattr(repeats, "FLUSH", flush)
    rnd = random.Random(3)
    parts = ["ab", "c", "dé", "eee", "f g", "hij", " ", "\n"]

    def text(n):
        return "".join(rnd.choice(parts) for _ in range(n))

    base = [text(200) for _ in range(4)]
    rows = [(1000, "a" * 300), (1001, "ab " * 90), (1002, "ab " * 60 + "x"), (1003, None), (1004, "")]
    for i in range(40):
        x, y = rnd.randint(0, 150), rnd.randint(0, 250)
        rows.append((i, text(rnd.randint(0, 40)) + rnd.choice(base)[x : x + y] + text(20) + base[0][: rnd.randint(0, 80)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df, 40) == brute(rows, 40)


def test_empty_table_and_short_length(empty):
    assert find_repeats(empty).collect() == []
    with pytest.raises(ValueError):
        find_repeats(empty, 8)


def test_different_strings_of_equal_weak_names(spark):
    """Thue-Morse runs of chosen letters, whose polynomials modulo 2^64 over the odd base of ``Ranks`` are equal."""
    signs = [bin(i).count("1") & 1 for i in range(32)]
    start = ("000044 " + "the common opening of two documents that go on in different ways " * 3)[:176]
    one, other = (start + "".join((x, y)[s ^ turn] for x, y in zip("WprGfLk", "YCVvYur") for s in signs) for turn in (0, 1))
    raw = [repeats.Ranks(np.frombuffer(t.encode(), np.uint8)) for t in (one, other)]
    assert one != other and raw[0].name(*np.array([[0], [400]])) == raw[1].name(*np.array([[0], [400]]))
    rnd = random.Random(4)
    before, after = ("".join(rnd.choice("etaoin shrdlu") for _ in range(390)) for _ in range(2))
    rows = [(1, one), (2, other), (3, before + one + after), (4, before + other + after)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert found(df, 400) == brute(rows, 400)
    rows = rows[:2]
    assert found(df.filter("doc_id < 3"), 400) == brute(rows, 400)
    assert all(removed == 0 for _, _, removed, _, _ in brute(rows, 400))


def test_periods_and_thue_morse_at_400_bytes(spark):
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    rows = [(1, thue), (2, thue[1024:2048] + "x"), (3, thue[::-1][:1500]), (4, "abc" * 400), (5, "bca" * 133 + "b"),
            (6, "z" * 400), (7, "z" * 399), (8, "z" * 401), (9, thue.translate({97: 98, 98: 97})[:2500])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df, 400) == brute(rows, 400)
