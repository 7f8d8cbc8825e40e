"""Array helpers shared by the operators that work on Arrow batches of whole texts."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one vectorised step works on; longer single texts are one step of their own.
STEP_BYTES = 1 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; null is an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offset of each text; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(column: pa.Array, limit: int = STEP_BYTES):
    """(first row, bytes, offsets) for runs of whole texts of about ``limit`` bytes."""
    if not len(column):
        return
    raw, at = utf8(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that every bit depends on every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def random_words(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64, n, np.uint64) | np.uint64(1)


def hash_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit tabulation hash of ``raw[start:end]`` for disjoint, ascending runs of at least one byte."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    cells = random_words(64 * 256, 1)[((inside & 63) << 8) | raw[inside + np.repeat(starts, lengths)]]
    if lengths.max() > 64:
        cells = cells * (mix((inside >> 6) + 7) | np.uint64(1))
    return mix(np.add.reduceat(cells, first) + lengths.astype(np.uint64))


def runs(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``member`` bytes that stay inside one text: starts, ends, text number."""
    if not len(member):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    edge = np.zeros(len(member) + 1, bool)
    edge[at] = True
    before = np.empty(len(member), bool)
    before[0] = False
    before[1:] = member[:-1]
    starts = np.flatnonzero(member & (~before | edge[:-1]))
    after = np.empty(len(member), bool)
    after[-1] = False
    after[:-1] = member[1:]
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def spread(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first[0] .. first[0]+lengths[0]-1, first[1] .. and so on, as one index array."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first, lengths)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte planes one after the other (they compress well)."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(blob: bytes, width: int) -> np.ndarray:
    cells = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((cells.shape[1], 8), np.uint8)
    out[:, :width] = cells.T
    return out.view("<u8").ravel()


def width_of(values: np.ndarray) -> int:
    return max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
