from __future__ import annotations

import re

import pytest

from paperloom.llm import contamination
from paperloom.llm.contamination import drop_contaminated, find_contamination


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items, size):
    out = []
    windows = []
    for i, t in items:
        w = tokens(t)
        if w:
            windows += [(i, w[k : k + size]) for k in range(max(1, len(w) - size + 1))]
    for i, t in texts:
        w, hit, names = tokens(t), set(), set()
        for name, window in windows:
            for k in range(len(w) - len(window) + 1):
                if w[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    names.add(name)
        out.append((i, len(w), len(hit), tuple(sorted(str(n) for n in names if n is not None))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(texts):
    base = texts[6][1].split()
    return [(10, " ".join(base[5:20])), (9, " ".join(base[10:17])), (2, "one"), (3, None), (4, ""), (5, "no such words here"),
            (None, "two three"), (10, " ".join(base[5:20])), (7, "ÜNDER réal")]


@pytest.mark.parametrize("limit", [8 << 20, 60])
def test_against_brute_force(spark, docs, texts, items, limit, monkeypatch):
    """Also with automata so small that the benchmark is scanned for in many parts."""
    monkeypatch.setattr(contamination, "AUTOMATON_BYTES", limit)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(docs, benchmark, size=6).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in got), key=repr) == brute(texts, items, 6)
    for r in got:
        candidates = [t for i, t in texts if i == r.doc_id]
        shown = [sum(len(tokens(t[s.start : s.end])) for s in r.spans) for t in candidates if t] or [0]
        assert r.n_hit in shown


def test_empty_tables_and_filter(spark, docs, empty, texts, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    none = benchmark.filter("false")
    assert find_contamination(empty, benchmark).collect() == []
    assert {r.n_hit for r in find_contamination(docs, none).collect()} == {0}
    kept = drop_contaminated(docs, benchmark, size=6)
    assert kept.columns == docs.columns
    clean = sorted((repr(i) for i, _, hit, _ in brute(texts, items, 6) if not hit))
    assert sorted(repr(r.doc_id) for r in kept.collect()) == clean
