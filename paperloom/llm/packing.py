"""Texts compressed together for a shuffle, by bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .arrays import utf8


def pack_texts(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, ..., text) as runs of texts of one bucket.

    The columns between become arrays, one value a text, ``sizes`` holds the
    texts' bytes and ``texts`` the texts one after the other, compressed. A null
    text is an empty one.
    """
    between = [(n, t) for n, t in rows.dtypes if n not in ("bucket", "text")]
    names = ["bucket", *[n for n, _ in between], "sizes", "texts"]

    def work(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column("bucket").to_numpy()
            order = np.argsort(number, kind="stable")
            ordered, number = batch.take(pa.array(order)), number[order]
            cut = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number))
            for a, b in zip(cut[:-1], cut[1:]):
                part = ordered.slice(a, b - a)
                raw, at = utf8(part.column("text"))
                columns = [part.column(n) for n, _ in between]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(number[a])], pa.int32()),
                    *[pa.array([c.to_pylist()], pa.list_(c.type)) for c in columns],
                    pa.array([np.diff(at).astype("<u4").tobytes()], pa.binary()),
                    pa.array([squeeze.compress(raw.tobytes())], pa.binary())], names)

    return rows.select("bucket", *[n for n, _ in between], "text").mapInArrow(work, ", ".join(
        ["bucket int", *[f"{n} array<{t}>" for n, t in between], "sizes binary", "texts binary"]))


def unpack_texts(table: pa.Table):
    """(row as dict, bytes, sizes) of each packed run."""
    expand = zstandard.ZstdDecompressor()
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            raw = expand.decompress(row.pop("texts"))
            yield row, np.frombuffer(raw, np.uint8), np.frombuffer(row.pop("sizes"), "<u4").astype(np.int64)
