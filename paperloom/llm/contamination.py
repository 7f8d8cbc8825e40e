"""Benchmark decontamination with one Aho-Corasick automaton (operator 5)."""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import unused

#: Words are runs of anything but these bytes, after A-Z became a-z.
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of window text that one automaton holds; a larger benchmark is scanned for by parts.
AUTOMATON_BYTES = 8 << 20
#: Parts of a benchmark that may be sent to the executors.
MAX_PARTS = 64

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else (32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b) for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_windows(text: str | None, size: int) -> set[bytes]:
    """``size`` consecutive words each; a shorter item, but not an empty one, is one window."""
    found = words(text)
    if not found:
        return set()
    return {b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))}


def collect_windows(benchmark: DataFrame, size: int, item_id: str, text: str) -> list[dict[bytes, list[str]]]:
    """The benchmark's windows with the items they come from, in parts of bounded size."""
    parts: list[dict[bytes, list[str]]] = []
    used = AUTOMATON_BYTES
    for row in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        for window in sorted(item_windows(row["t"], size)):
            if used >= AUTOMATON_BYTES:
                if len(parts) == MAX_PARTS:
                    raise ValueError(f"the benchmark has more than {MAX_PARTS * AUTOMATON_BYTES} bytes of windows")
                parts.append({})
                used = 0
            if window not in parts[-1]:
                used += len(window)
            if row["i"] is not None:
                parts[-1].setdefault(window, []).append(row["i"])
            else:
                parts[-1].setdefault(window, [])
    return parts


def build_automaton(windows: dict[bytes, list[str]]):
    automaton = ahocorasick.Automaton()
    for window, items in windows.items():
        automaton.add_word(f" {window.decode()} ", (window.count(b" ") + 1, items))
    automaton.make_automaton()
    return automaton


_built: dict = {}


def _automaton(key, shared):
    """The worker's automaton of a broadcast part, built once and kept until another is asked for."""
    if key not in _built:
        _built.clear()
        _built[key] = build_automaton(shared.value)
    return _built[key]


def scan_text(text: str | None, automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, merged word ranges inside matched windows, and the items matched."""
    found = words(text)
    if not found or not len(automaton):
        return len(found), [], set()
    line = b" " + b" ".join(found) + b" "
    chars = line.decode()
    ranges, items, gaps = [], set(), None
    for end, (length, names) in automaton.iter(chars):
        if gaps is None:
            gaps = np.flatnonzero(np.frombuffer(chars.encode("utf-32-le"), np.uint32) == ord(" "))
        last = int(np.searchsorted(gaps, end))
        begin = last - length
        items.update(names)
        if ranges and begin <= ranges[-1][1]:
            ranges[-1][0] = min(ranges[-1][0], begin)
            ranges[-1][1] = max(ranges[-1][1], last)
            while len(ranges) > 1 and ranges[-1][0] <= ranges[-2][1]:
                low, high = ranges.pop()
                ranges[-1][0] = min(ranges[-1][0], low)
                ranges[-1][1] = max(ranges[-1][1], high)
        else:
            ranges.append([begin, last])
    return len(found), [tuple(r) for r in ranges], items


_WORD_OF_TEXT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def to_offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character offsets of the original text."""
    if not ranges:
        return []
    marks = [m.span() for m in _WORD_OF_TEXT.finditer(text)]
    return [(marks[a][0], marks[b - 1][1]) for a, b in ranges]


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, doc_id: str = "doc_id",
                       text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, text_key), one row per row of ``docs``.

    ``items`` are the benchmark items with a window in the text, sorted as
    strings; ``spans`` the character offsets of the maximal runs of hit words in
    the original text; ``text_key`` a 64-bit hash of the text, to find the row
    again. A benchmark whose windows exceed ``AUTOMATON_BYTES`` is scanned for
    in parts, all of them in one pass over the text, one automaton at a time.

    Documents are scanned where they lie: no shuffle. A null or empty text has no
    words and no hits; null or empty items have no windows; a null ``item_id``
    counts hits but is not listed. Repeated rows and items give the same rows and
    the same lists again. Empty tables give no rows, or rows without hits. Other
    columns are not read.
    """
    spark = docs.sparkSession
    parts = [(uuid.uuid4().hex, spark.sparkContext.broadcast(p))
             for p in collect_windows(benchmark, size, item_id, item_text)]

    def scan(batches):
        for batch in batches:
            texts = batch.column(1)
            counts, ranges, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
            for part in parts or [None]:
                automaton = _automaton(*part) if part else ()
                for i, cell in enumerate(texts):
                    n, r, names = scan_text(cell.as_py(), automaton)
                    counts[i] = n
                    ranges[i] += r
                    items[i] |= names
            merged = [merge_ranges(r) for r in ranges]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array([sum(b - a for a, b in r) for r in merged], pa.int64()),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                pa.array([[{"start": a, "end": b} for a, b in to_offsets(texts[i].as_py(), r)] if r else []
                          for i, r in enumerate(merged)],
                         pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                batch.column(2),
            ], ["doc_id", "n_words", "n_hit", "items", "spans", "text_key"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    return picked.mapInArrow(scan, (
        f"doc_id {dict(picked.dtypes)['doc_id']}, n_words long, n_hit long, items array<string>, "
        "spans array<struct<start:long,end:long>>, text_key long"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, doc_id: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns, whatever their names.

    Null, empty, repeated and very long texts, null ids and empty tables are as in ``find_contamination``: texts without
    words stay.
    """
    hid, hkey, key = unused(docs, "hit_id", "hit_key", "text_key")
    hit = find_contamination(docs, benchmark, size, doc_id, text).filter("n_hit > 0").select(
        F.col("doc_id").alias(hid), F.col("text_key").alias(hkey)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(text))
    return keyed.join(
        hit, F.col(doc_id).eqNullSafe(F.col(hid)) & (F.col(key) == F.col(hkey)), "left_anti").drop(key)
