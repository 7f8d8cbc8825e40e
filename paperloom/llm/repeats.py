"""Removal of byte strings that occur more than once, by sparse prefix doubling (operator 6)."""

from __future__ import annotations

import functools
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrays import from_planes, mix, planes, random_words, spread, steps, width_of
from .packing import pack_texts, unpack_texts

#: Bytes of an anchor's own string; window starts that one anchor may serve.
GRAM, REACH = 16, 256
#: Anchors that a worker gathers before it sends them; characters per bucket; different contexts of an
#: anchor that one worker sends of a common string before it sends the rest straight to the next round.
FLUSH, BUCKET_CHARS, PROBES = 1 << 20, 16 << 20, 8

#: Bytes of a window's weak name that are kept beside its strong one.
TAIL = 3

_BASE = 0x9E3779B97F4A7C15
_PRIME = (1 << 61) - 1
_LOW, _HALF = np.uint64((1 << 31) - 1), np.uint64(31)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        power = np.full(n, base, np.uint64)
        power[0] = 1
        out.append(np.multiply.accumulate(power))
    return out[0], out[1]


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(_PRIME), x - np.uint64(_PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo ``_PRIME`` of numbers below it, by halves of 31 bits."""
    a_high, a_low, b_high, b_low = a >> _HALF, a & _LOW, b >> _HALF, b & _LOW
    middle = a_high * b_low + a_low * b_high
    return _reduce((a_high * b_high << np.uint64(1)) + (middle >> np.uint64(30))
                   + ((middle & np.uint64((1 << 30) - 1)) << _HALF) + a_low * b_low)


@functools.lru_cache(maxsize=2)
def _prime_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for root in (base, pow(base, -1, _PRIME)):
        power = np.ones(1, np.uint64)
        while len(power) < n:
            power = np.append(power, _times(power, np.uint64(pow(root, len(power), _PRIME))))
        out.append(power[:n])
    return out[0], out[1]


class Names:
    """Names of substrings of under 16 MB that decide what is equal: polynomials modulo a prime.

    ``base`` is drawn anew for each run, so no text can be made up to hold
    different strings of one name.
    """

    def __init__(self, raw: np.ndarray, base: int):
        up, self.down = _prime_powers(base, 1 << max(20, len(raw).bit_length()))
        up, value = up[: len(raw)], raw.astype(np.uint64) + np.uint64(1)
        # Sums may pass 2^64: differences over one string do not.
        self.low, self.high = (np.append(np.uint64(0), np.cumsum(value * x, dtype=np.uint64))
                               for x in (up & _LOW, up >> _HALF))

    def name(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        high = _times(_reduce(self.high[end] - self.high[begin]), np.uint64(1) << _HALF)
        return mix(_times(_reduce(_reduce(self.low[end] - self.low[begin]) + high), self.down[begin]))


class Ranks:
    """Weak names of the substrings of a byte array: equal strings have equal 64-bit names.

    They are fixed and modulo 2^64, so different strings of equal names can be
    made up; they choose what is compared and never decide that it is equal.
    """

    def __init__(self, raw: np.ndarray):
        size = 1 << max(20, len(raw).bit_length())
        up, self.down = _powers(size)
        self.sums = np.append(np.uint64(0), np.cumsum(random_words(256, 21)[raw] * up[: len(raw)], dtype=np.uint64))

    def name(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def anchors(raw: np.ndarray, at: np.ndarray, length: int, base: int):
    """Anchors of all windows of ``length`` bytes: text, position, smallest and largest distance to a window start,
    weak name of the core that all their windows contain, name of the hull around them (0 where it leaves the text).

    A window's anchor is the leftmost smallest named string of ``GRAM`` bytes
    that begins within its first ``REACH`` bytes, so equal windows have equal
    anchors at equal distances.
    """
    reach = min(REACH, length - GRAM + 1)
    empty = np.zeros(0, np.int64)
    if len(raw) < length:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    ranks = Ranks(raw)
    here = np.arange(len(raw) - GRAM + 1)
    value, place = ranks.name(here, here + GRAM), here
    covered = 1
    while covered < reach:
        step = min(covered, reach - covered)
        later = value[step:] < value[: len(value) - step]
        value = np.where(later, value[step:], value[: len(value) - step])
        place = np.where(later, place[step:], place[: len(place) - step])
        covered += step
    text = np.searchsorted(at, here[: len(place)], "right") - 1
    whole = np.flatnonzero(here[: len(place)] + length <= at[text + 1])
    place, text = place[whole], text[whole]
    if not len(whole):
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
    last = np.append(first[1:], len(place)) - 1
    spot, owner = place[first], text[first]
    core = ranks.name(spot, spot + length - reach + 1)
    low, high = spot - reach + 1, spot + length
    inside = (low >= at[owner]) & (high <= at[owner + 1])
    del ranks, value, here
    names = Names(raw, base).name(np.maximum(low, 0), np.minimum(high, len(raw)))
    hull = np.where(inside, names | np.uint64(1), np.uint64(0))
    return owner, spot - at[owner], spot - whole[last], spot - whole[first], core, hull


_NAMES = ("kind", "bucket", "head", "width", "names", "hulls", "often", "owners", "keys", "a", "b")
_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7)
_SCHEMA = ("kind int, bucket int, head long, width int, names binary, hulls binary, often binary, owners binary, "
           "keys binary, a binary, b binary")
#: Rows to be ranked by name, spans found to be repeated, anchors whose windows are ranked one by one.
PROBE, SPAN, OPEN = 0, 1, 2


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in _NAMES]
    return pa.table([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=list(_NAMES))


def _by_name(name, hull, often, key, a, b, buckets: int, width: int = 8) -> list[tuple]:
    """Packed rows to be ranked, by bucket of their name; ``width`` bytes of ``hull`` are kept."""
    order = np.argsort(name, kind="stable")
    name, hull, key, a = name[order], hull[order], key[order], a[order]
    often, b = (None if x is None else x[order] for x in (often, b))
    number = ((name >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    cut = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(name)) if len(name) else [0]
    rows = []
    for x, y in zip(cut[:-1], cut[1:]):
        step = np.diff(name[x:y], prepend=name[x])
        used, local = np.unique(key[x:y], return_inverse=True)
        wide = width_of(step)
        rows.append((PROBE, int(number[x]), int(name[x : x + 1].view(np.int64)[0]), wide, planes(step, wide),
                     planes(hull[x:y], width), b"" if often is None else often[x:y].tobytes(),
                     planes(local.astype(np.uint64), 3), used.tobytes(), a[x:y].astype("<u4").tobytes(),
                     b"" if b is None else b[x:y].astype("<u4").tobytes()))
    return rows


def _by_text(kind: int, key, a, b, buckets: int) -> list[tuple]:
    """Packed findings, by bucket of their text."""
    number = (key.view(np.int64) % buckets).astype(np.int64)
    order = np.lexsort((a, key, number))
    key, a, b, number = key[order], a[order], b[order], number[order]
    cut = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(key)) if len(key) else [0]
    rows = []
    for x, y in zip(cut[:-1], cut[1:]):
        used, local = np.unique(key[x:y], return_inverse=True)
        rows.append((kind, int(number[x]), 0, 0, b"", b"", b"", planes(local.astype(np.uint64), 3), used.tobytes(),
                     a[x:y].astype("<u4").tobytes(), b[x:y].astype("<u4").tobytes()))
    return rows


def _merge(key, start, end):
    """Overlapping or touching spans of one text as one."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    base = np.cumsum(np.append(False, key[1:] != key[:-1])).astype(np.int64) << 33
    furthest = np.maximum.accumulate(end + base)
    first = np.flatnonzero(np.append(True, start[1:] + base[1:] > furthest[:-1]))
    last = np.append(first[1:], len(key)) - 1
    return key[first], start[first], (furthest - base)[last]


def _split(core, hull, often, mixed, key, spot, reach, length, buckets, limit):
    """What a set of anchor rows shows by itself: (rows to send on, spans found, anchors to open).

    ``reach`` packs the distances to the first and last window start. Anchors of
    one core and one hull are repeated with all their windows. Where a core has
    several hulls, one anchor of each is opened. ``limit``: hulls of a core that
    are sent on, None when all rows of a core are here.
    """
    order = np.lexsort((hull, core))
    core, hull, often, mixed, key, spot, reach = (x[order] for x in (core, hull, often, mixed, key, spot, reach))
    same_core = np.append(False, core[1:] == core[:-1])
    same_hull = np.append(False, (core[1:] == core[:-1]) & (hull[1:] == hull[:-1]))
    lead = np.flatnonzero(~same_hull)
    group = np.cumsum(~same_hull) - 1
    total = np.add.reduceat(often.astype(np.int64), lead)
    repeated = (total > 1)[group]
    core_of = np.cumsum(~same_core[lead]) - 1
    hulls = np.bincount(core_of)[core_of]
    any_mixed = np.maximum.reduceat(mixed.astype(np.int8), np.flatnonzero(~same_core)) > 0
    low, high = reach & 0xFFFF, reach >> 16
    spans = _merge(key[repeated], (spot - high)[repeated], (spot - low)[repeated] + length)
    if limit is None:
        open_rows = lead[(hulls > 1) | any_mixed[core_of]]
        return None, spans, (key[open_rows], spot[open_rows], reach[open_rows])
    nth = np.arange(len(lead)) - np.flatnonzero(np.append(True, core_of[1:] != core_of[:-1]))[core_of]
    beyond = lead[nth >= limit]
    send = lead[nth < limit]
    crowded = hulls[nth < limit] > limit
    sent = (core[send], hull[send], np.minimum(total[nth < limit], 2).astype(np.uint8), crowded, key[send], spot[send],
            reach[send])
    return sent, spans, (key[beyond], spot[beyond], reach[beyond])


def find_anchors(docs: DataFrame, length: int, buckets: int, base: int) -> DataFrame:
    """First round: the anchors of all texts, as rows to be ranked, spans and anchors to open."""

    def work(batches):
        held, count = [], 0

        def flush():
            core, hull, key, spot, reach = (np.concatenate(x) for x in zip(*held))
            held.clear()
            alone = hull == 0
            hull = np.where(alone, mix(key ^ mix(spot.astype(np.uint64))) & ~np.uint64(1), hull)
            sent, spans, opened = _split(core, hull, np.ones(len(core), np.uint8), np.zeros(len(core), bool), key, spot,
                                         reach, length, buckets, PROBES)
            core, hull, often, crowded, key, spot, reach = sent
            rows = _by_name(core, hull, often | (crowded.astype(np.uint8) << 4), key, spot, reach, buckets)
            rows += _by_text(SPAN, *spans, buckets) + _by_text(OPEN, *opened, buckets)
            for i in range(0, len(rows), 64):
                yield from _table(rows[i : i + 64]).to_batches()

        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            for row, raw, at in steps(batch.column(1)):
                owner, spot, low, high, core, hull = anchors(raw, at, length, base)
                held.append((core, hull, keys[row + owner], spot, low | (high << 16)))
                count += len(core)
                if count >= FLUSH:
                    yield from flush()
                    count = 0
        if count:
            yield from flush()

    return docs.select("row_key", "text").mapInArrow(work, _SCHEMA)


def _read(table: pa.Table):
    """Columns of packed rows: key, a, b as arrays over all rows."""
    keys, first, second = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for owners, used, a, b in zip(*(table.column(n).to_pylist() for n in ("owners", "keys", "a", "b"))):
        local = from_planes(owners, 3).astype(np.int64)
        keys.append(np.frombuffer(used, np.uint64)[local])
        first.append(np.frombuffer(a, "<u4").astype(np.int64))
        second.append(np.frombuffer(b, "<u4").astype(np.int64) if b else np.zeros(len(local), np.int64))
    return np.concatenate(keys), np.concatenate(first), np.concatenate(second)


def _names(table: pa.Table, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Names and hulls of packed rows."""
    out, hulls = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for head, wide, names, hull in zip(*(table.column(n).to_pylist() for n in ("head", "width", "names", "hulls"))):
        out.append(np.cumsum(from_planes(names, wide), dtype=np.uint64) + np.array([head], np.int64).view(np.uint64))
        hulls.append(from_planes(hull, width))
    return np.concatenate(out), np.concatenate(hulls)


def rank_anchors(probes: DataFrame, length: int, buckets: int) -> DataFrame:
    """Second round: anchors by the names of their cores; unique cores drop out."""

    def work(table: pa.Table) -> pa.Table:
        core, hull = _names(table)
        if not len(core):
            return _table([])
        key, spot, reach = _read(table)
        often = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("often").to_pylist()])
        _, spans, opened = _split(core, hull, often & 15, often > 15, key, spot, reach, length, buckets, None)
        return _table(_by_text(SPAN, *spans, buckets) + _by_text(OPEN, *opened, buckets))

    return probes.groupBy("bucket").applyInArrow(work, _SCHEMA)


def open_windows(packed: DataFrame, opened: DataFrame, length: int, buckets: int, base: int) -> DataFrame:
    """Third round: every window of the opened anchors, named twice by all its bytes, as rows to be ranked."""

    def work(texts: pa.Table, found: pa.Table) -> pa.Table:
        key, spot, reach = _read(found)
        order = np.argsort(key, kind="stable")
        key, spot, reach = key[order], spot[order], reach[order]
        names, tails, keys, starts, rows = [], [], [], [], []

        def send():
            if names:
                rows.extend(_by_name(np.concatenate(names), np.concatenate(tails), None, np.concatenate(keys),
                                     np.concatenate(starts), None, buckets, TAIL))
                names.clear(), tails.clear(), keys.clear(), starts.clear()

        for row, raw, sizes in unpack_texts(texts) if len(key) else ():
            ends = np.cumsum(sizes)
            for mine, end, size in zip(np.array(row["row_key"], np.int64).view(np.uint64), ends, sizes):
                a, b = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
                if a == b:
                    continue
                low, high = reach[a:b] & 0xFFFF, reach[a:b] >> 16
                start = np.unique(spread(high - low + 1, spot[a:b] - high))
                own = raw[end - size : end]
                names.append(Names(own, base).name(start, start + length))
                tails.append(Ranks(own).name(start, start + length))
                keys.append(np.full(len(start), mine))
                starts.append(start)
                if sum(map(len, names)) > FLUSH:
                    send()
        send()
        return _table(rows)

    return packed.groupBy("bucket").cogroup(opened.groupBy("bucket")).applyInArrow(work, _SCHEMA)


def rank_windows(windows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Fourth round: windows whose whole string occurs again, as spans."""

    def work(table: pa.Table) -> pa.Table:
        name, tail = _names(table, TAIL)
        key, start, _ = _read(table)
        order = np.lexsort((tail, name))
        name, tail = name[order], tail[order]
        same = np.append(False, (name[1:] == name[:-1]) & (tail[1:] == tail[:-1]))
        again = order[same | np.append(same[1:], False)]
        return _table(_by_text(SPAN, *_merge(key[again], start[again], start[again] + length), buckets))

    return windows.groupBy("bucket").applyInArrow(work, _SCHEMA)


def find_repeats(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept), one row per row of ``docs``.

    Removed is every byte covered by a string of ``length`` bytes that also
    starts elsewhere in the table, in the same text or another; strings do not
    cross texts and are judged on the input. ``spans`` are the maximal removed
    runs as byte offsets, ``kept`` the remaining bytes.

    Positions are ranked by growing strings, unique ones drop out. All windows
    are represented by anchors that depend on their content alone. The first rank
    compares the core that an anchor's windows have in common; an anchor whose
    core is unique is done. Anchors of equal cores whose surroundings are equal as
    well are repeated as a whole. Only what is left is ranked window by window,
    by all its bytes. Ranks are names of strings instead of sort numbers, so no
    round has to look up a neighbour's rank. What is equal is decided by names
    modulo a prime at a base drawn for the run, so texts cannot be made to differ
    under one name, with bits of a second name against chance.

    A string that very many texts share is combined in each task before it is
    sent, and windows are dealt by their own names, so no task meets all places
    of a common passage. Texts travel compressed, twice.

    Null and empty texts, and those shorter than ``length``, lose nothing.
    Repeated rows are copies of each other. An empty table gives no rows; other
    columns are not read. Memory of a task grows with the longest single text, by
    about 80 bytes a byte.
    """
    if not GRAM <= length < 1 << 23:
        raise ValueError(f"strings must have {GRAM} bytes to 8 MB")
    base = secrets.randbelow(_PRIME - 3) + 2
    spark = docs.sparkSession
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // BUCKET_CHARS)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row_key"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    packed = pack_texts(rows.select(F.pmod("row_key", F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "row_key",
                                    "text"))
    first = materialise(find_anchors(rows, length, buckets, base), "anchors")
    ranked = materialise(rank_anchors(first.filter(F.col("kind") == PROBE), length, buckets), "ranked")
    known = first.filter(F.col("kind") != PROBE).union(ranked)
    windows = open_windows(packed, known.filter(F.col("kind") == OPEN), length, buckets, base)
    last = materialise(rank_windows(windows, length, buckets), "windows")
    spans = known.filter(F.col("kind") == SPAN).union(last)

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        key, a, b = _merge(*_read(found))
        out = {"doc_id": [], "n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        for row, raw, sizes in unpack_texts(texts):
            ends = np.cumsum(sizes)
            numbers = np.array(row["row_key"], np.int64).view(np.uint64)
            for doc, mine, end, size in zip(row["doc_id"], numbers, ends, sizes):
                x, y = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
                own = raw[end - size : end]
                gone = np.zeros(0, np.int64)
                if y > x:
                    gone = spread(b[x:y] - a[x:y], a[x:y])
                    own = np.delete(own, gone)
                out["doc_id"].append(doc)
                out["n_bytes"].append(int(size))
                out["n_removed"].append(len(gone))
                out["spans"].append([{"start": int(i), "end": int(j)} for i, j in zip(a[x:y], b[x:y])])
                out["kept"].append(own.tobytes())
        kinds = (texts.schema.field("doc_id").type.value_type, pa.int64(), pa.int64(),
                 pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds)})

    return packed.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
