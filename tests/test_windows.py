"""Anchored windows against a walk over the events, and as a stream."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from paperloom.streaming import windows as W
from paperloom.streaming.jobs import run_available, stream_files

START = datetime(2024, 1, 1)


def walk(rows, seconds, reopen_at_end):
    out, state = {}, {}
    for user, ts, event in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        anchor, n = state.get(user, (None, 0))
        end = anchor + timedelta(seconds=seconds) if anchor else None
        if anchor is None or (ts >= end if reopen_at_end else ts > end):
            anchor, n = ts, 0
        state[user] = (anchor, n + 1)
        out[event] = n + 1
    return out


def make(spark, seed, n=1500):
    rng = random.Random(seed)
    # One user holds most rows; steps of whole seconds give ties and exact ends.
    rows = [(rng.choice([1, 1, 1, 2, 3]), START + timedelta(seconds=rng.randrange(4000)), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "user_id int, ts timestamp, event_id int")


@pytest.mark.parametrize("seed, seconds, block, reopen", [(1, 60, 3600, False), (2, 60, 60, False), (3, 60, 17, True), (4, 600, 300, True), (5, 7, 1000, False)])
def test_batch_equals_walk(spark, seed, seconds, block, reopen):
    rows, df = make(spark, seed)
    got = W.anchored_windows(df, ["user_id"], seconds, reopen_at_end=reopen, block_seconds=block)
    assert {r.event_id: r.number for r in got.collect()} == walk(rows, seconds, reopen)


def test_bursts(spark):
    rows = [(1, START + timedelta(seconds=i), i) for i in range(21)]
    rows += [(1, START + timedelta(seconds=60), 30), (1, START + timedelta(seconds=121), 31)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, event_id int")
    got = {r.event_id: (r.number, r.refused) for r in W.window_budget(df, ["user_id"], 20).collect()}
    assert got[20] == (21, True) and got[19] == (20, False)
    assert got[30] == (22, True) and got[31] == (1, False)


def test_stream_equals_batch(spark, tmp_path):
    rows, df = make(spark, 9, 400)
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    # Files in time order, so no row is late; several triggers.
    for part in range(4):
        cut = ordered[part * 100 : (part + 1) * 100]
        spark.createDataFrame(cut, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = stream_files(spark, str(tmp_path / "in"), "*.parquet", df.schema, files_per_trigger=1)
    out = spark.read.parquet(run_available(W.window_budget_stream(src, ["user_id"], 20, watermark="2 hours"), "t"))
    assert {r.event_id: r.number for r in out.collect()} == walk(rows, 60, False)


def test_stream_of_many_keys_in_few_groups(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(80)]), START + timedelta(seconds=rng.randrange(8000)), i) for i in range(900)]
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    schema = "user_id int, ts timestamp, event_id int"
    for part in range(3):
        spark.createDataFrame(ordered[part * 300 : (part + 1) * 300], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = stream_files(spark, str(tmp_path / "in"), "*.parquet", schema, files_per_trigger=1)
    budget = W.window_budget_stream(src, ["user_id"], 2, 600, watermark="3 hours", shards=4)
    query = budget.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    # Every user's window is kept, in a group of state for each shard.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 4
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = walk([(-1 if u is None else u, t, e) for u, t, e in rows], 600, False)
    assert {r.event_id: r.number for r in got} == want and all(r.refused == (r.number > 2) for r in got)
    assert {(r.user_id, r.event_id) for r in got} == {(u, e) for u, _, e in rows}
