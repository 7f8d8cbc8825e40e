"""Fixed windows that open at a key's first event (L2, L3), in batch and as a stream.

A window is anchored at the first event of a key, lasts ``seconds``, and the
next one opens at the first event after it. The chain of anchors is sequential
per key, so the batch form cuts each key's time line into blocks, condenses what
a block does to any incoming anchor into a short step function, folds those per
key, and then numbers the events of all blocks in parallel. No task ever holds
more than one block of one key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.defaults import LOOKUP_TTL_SECONDS, WINDOW_SECONDS

MICROS = 1_000_000
#: Groups that share the keys of a stream.
SHARDS = 1024


def _side(reopen_at_end: bool) -> str:
    """Whether an event exactly at the end opens a new window."""
    return "left" if reopen_at_end else "right"


def number_events(ts: np.ndarray, width: int, side: str, anchor: int | None, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Window start and running number of each event, given the window still open."""
    starts, numbers = np.empty(len(ts), np.int64), np.empty(len(ts), np.int64)
    at = 0
    while at < len(ts):
        open_until = None if anchor is None else int(np.searchsorted(ts, anchor + width, side=side))
        if open_until is None or open_until <= at:
            anchor, count = int(ts[at]), 0
            open_until = int(np.searchsorted(ts, anchor + width, side=side))
        starts[at:open_until] = anchor
        numbers[at:open_until] = np.arange(count + 1, count + 1 + open_until - at)
        count += open_until - at
        at = open_until
    return starts, numbers


def block_steps(ts: np.ndarray, width: int, side: str, begins: int) -> dict:
    """What one block of events does to an anchor that enters it.

    ``last[i]``: an anchor whose window ends before ``last[i]`` leaves the block
    as anchor ``anchor[i]`` with ``count[i]`` events. When its window covers the
    whole block it leaves unchanged, ``n`` events richer.
    """
    n = len(ts)
    nxt = np.searchsorted(ts, ts + width, side=side)
    jump = np.where(nxt < n, nxt, np.arange(n))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    # Only events reachable as the first one after an incoming window matter.
    reach = min(n, int(np.searchsorted(ts, begins + width, side="right")) + 1)
    ends = jump[:reach]
    runs = np.flatnonzero(np.append(ends[1:] != ends[:-1], True))
    return {"n": n, "last": ts[runs].tolist(), "anchor": ts[ends[runs]].tolist(), "count": (n - ends[runs]).tolist()}


def leave_block(step, anchor: int | None, count: int, width: int, side: str) -> tuple[int, int]:
    """Anchor and count after a block, given those that enter it."""
    # Without an open window the first event of the block opens one.
    at = 0 if anchor is None else int(np.searchsorted(step.last, anchor + width, side=side))
    if at < len(step.anchor):
        return int(step.anchor[at]), int(step.count[at])
    return anchor, count + int(step.n)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows that agree in all ``columns``."""
    n = len(columns[0])
    change = np.zeros(max(n - 1, 0), bool)
    for column in columns:
        change |= column[1:] != column[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return list(zip(cuts[:-1], cuts[1:])) if n else []


def anchored_windows(
    events: DataFrame, keys: list[str], seconds: int = WINDOW_SECONDS, *, id_col: str = "event_id", ts_col: str = "ts",
    reopen_at_end: bool = False, block_seconds: int = 3600,
) -> DataFrame:
    """``events`` with ``window_start`` (epoch microseconds) and ``number`` inside the window.

    Each step reads its partition as one sorted stream, so many small keys cost
    no more than a few large ones.
    """
    width, side = seconds * MICROS, _side(reopen_at_end)
    size = block_seconds * MICROS
    slim = (
        events.select(
            F.to_json(F.struct(*keys)).alias("_key"), *keys, id_col,
            F.unix_micros(F.col(ts_col).cast("timestamp")).alias("_us"),
        )
        .withColumn("_block", F.floor(F.col("_us") / size).cast("bigint"))
    )

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        owner = None

        def finish() -> tuple:
            steps = block_steps(np.concatenate(held), width, side, owner[1] * size)
            return (*owner, steps["n"], steps["last"], steps["anchor"], steps["count"])

        names = ["_key", "_block", "n", "last", "anchor", "count"]
        for frame in frames:
            key, block, ts = frame["_key"].to_numpy(), frame["_block"].to_numpy(), frame["_us"].to_numpy()
            rows = []
            for a, b in _runs(key, block):
                if owner != (key[a], int(block[a])):
                    if held:
                        rows.append(finish())
                    owner, held = (key[a], int(block[a])), []
                held.append(ts[a:b])
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if held:
            yield pd.DataFrame([finish()], columns=names)

    steps = (
        slim.select("_key", "_block", "_us").repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_us")
        .mapInPandas(summarise, "_key string, _block bigint, n bigint, last array<bigint>, anchor array<bigint>, count array<bigint>")
    )

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, anchor, count = None, None, 0
        for frame in frames:
            anchors, counts = [], []
            for row in frame.itertuples(index=False, name="Step"):
                if row[0] != owner:
                    owner, anchor, count = row[0], None, 0
                anchors.append(anchor)
                counts.append(count)
                anchor, count = leave_block(row, anchor, count, width, side)
            yield frame[["key", "block"]].assign(anchor=pd.array(anchors, dtype="Int64"), count=counts)

    carried = (
        steps.withColumnsRenamed({"_key": "key", "_block": "block"}).repartition("key").sortWithinPartitions("key", "block")
        .mapInPandas(chain, "key string, block bigint, anchor bigint, count bigint")
    )
    # What enters a block travels as a first row of that block.
    entering = carried.filter("anchor IS NOT NULL").select(
        F.col("key").alias("_key"), F.col("block").alias("_block"), F.lit(None).cast("bigint").alias("_us"),
        F.col("anchor").alias("_anchor"), F.col("count").alias("_count"),
    )
    fields = [events.schema[k] for k in keys]
    schema = StructType(
        [*fields, events.schema[id_col], StructField("window_start", LongType()), StructField("number", LongType())]
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, anchor, count = None, None, 0
        target = to_arrow_schema(schema)
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            key, block = (columns[n].to_numpy(zero_copy_only=False) for n in ("_key", "_block"))
            control = columns["_us"].is_null().to_numpy(zero_copy_only=False)
            ts = columns["_us"].fill_null(0).to_numpy(zero_copy_only=False)
            starts, numbers = np.zeros(len(ts), np.int64), np.zeros(len(ts), np.int64)
            for a, b in _runs(key, block):
                if owner != (key[a], block[a]):
                    owner, anchor, count = (key[a], block[a]), None, 0
                if control[a]:
                    anchor, count = columns["_anchor"][a].as_py(), columns["_count"][a].as_py()
                    a += 1
                if a < b:
                    starts[a:b], numbers[a:b] = number_events(ts[a:b], width, side, anchor, count)
                    anchor, count = int(starts[b - 1]), int(numbers[b - 1])
            arrays = [*(columns[n] for n in target.names[:-2]), pa.array(starts), pa.array(numbers)]
            rows = pa.RecordBatch.from_arrays(arrays, names=target.names)
            yield rows.filter(pa.array(~control)).cast(target)

    both = slim.unionByName(entering, allowMissingColumns=True)
    ordered = both.repartition("_key", "_block").sortWithinPartitions("_key", "_block", F.asc_nulls_first("_us"), id_col)
    return ordered.mapInArrow(number, schema)


def window_budget(events: DataFrame, keys: list[str], limits: dict[str, int] | int, kind_col: str | None = None, **options) -> DataFrame:
    """L2: event n of a window is refused when n exceeds the limit; refused ones count too.

    ``limits`` is one number or a number per value of ``kind_col``.
    """
    numbered = anchored_windows(events, keys, **options)
    if isinstance(limits, int):
        limit = F.lit(limits)
    else:
        limit = F.lit(None).cast("int")
        for kind, value in limits.items():
            limit = F.when(F.col(kind_col) == kind, value).otherwise(limit)
    return numbered.withColumn("refused", F.coalesce(F.col("number") > limit, F.lit(False)))


def lookup_replay(events: DataFrame, keys: list[str], seconds: int = LOOKUP_TTL_SECONDS, **options) -> DataFrame:
    """L3: the first lookup of a window fetches, the others hit; hits do not prolong it."""
    numbered = anchored_windows(events, keys, seconds, reopen_at_end=True, **options)
    return numbered.withColumn("hit", F.col("number") > 1)


def window_budget_stream(
    events: DataFrame, keys: list[str], limit: int, seconds: int = WINDOW_SECONDS, *, id_col: str = "event_id",
    ts_col: str = "ts", watermark: str = "1 minute", reopen_at_end: bool = False, shards: int = SHARDS,
) -> DataFrame:
    """L2 and L3 over a stream: state per key is the open window and its count.

    The state of a window that has ended is dropped when the watermark passes
    it; rows later than the watermark are not counted. Keys are many and mostly
    small, and a call of Python costs more than a key's rows: keys are dealt by
    hash to ``shards`` groups, each of which keeps the open windows of its keys.
    """
    width, side = seconds * MICROS, _side(reopen_at_end)
    source = events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    fields = [source.schema[k] for k in keys]
    out = StructType(
        [*fields, source.schema[id_col], StructField("window_start", LongType()), StructField("number", LongType())]
    )
    state_schema = StructType([StructField("key", ArrayType(StringType())), *[
        StructField(n, ArrayType(LongType())) for n in ("anchor", "count")]])
    slim = source.select(
        F.pmod(F.xxhash64(*keys), F.lit(shards)).alias("_shard"), F.to_json(F.struct(*keys)).alias("_key"), *keys, id_col, ts_col,
        F.unix_micros(ts_col).alias("_us"))

    def step(shard: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (anchor, count) for k, anchor, count in zip(*state.get)} if state.exists else {}
        rows = None
        if not state.hasTimedOut:
            # A shard's rows may come in several frames of one trigger.
            part = pd.concat(list(frames), ignore_index=True)
            codes, owners = pd.factorize(part["_key"])
            order = np.lexsort((part[id_col].to_numpy(), part["_us"].to_numpy(), codes))
            part, codes = part.take(order), codes[order]
            ts = part["_us"].to_numpy()
            starts, numbers = np.empty(len(ts), np.int64), np.empty(len(ts), np.int64)
            for a, b in _runs(codes):
                owner = owners[codes[a]]
                starts[a:b], numbers[a:b] = number_events(ts[a:b], width, side, *held.get(owner, (None, 0)))
                held[owner] = int(starts[b - 1]), int(numbers[b - 1])
            rows = part[[*keys, id_col]].assign(window_start=starts, number=numbers)
        passed = state.getCurrentWatermarkMs()
        ends_ms = {k: int(anchor + width) // 1000 + 1 for k, (anchor, _) in held.items()}
        open_still = [k for k in held if ends_ms[k] > passed]
        if open_still:
            state.update((open_still, [held[k][0] for k in open_still], [held[k][1] for k in open_still]))
            state.setTimeoutTimestamp(min(ends_ms[k] for k in open_still))
        elif state.exists:
            state.remove()
        if rows is not None:
            yield rows

    return (
        slim.groupBy("_shard")
        .applyInPandasWithState(step, out, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
        .withColumn("refused", F.col("number") > limit)
    )
