"""Uploads that are suppressed for ever."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest

from paperloom.sources.versions import latest, read_versions
from paperloom.streaming import lifetime as L
from paperloom.streaming.jobs import stream_files

SCHEMA = "user_id long, content_hash string, ts timestamp, n long"


def stored(spark, table):
    return sorted((r.user_id or -1, r.content_hash or "", r.n) for r in read_versions(spark, table, "upload_key").collect())


def test_batches_years_apart(spark, tmp_path, monkeypatch):
    table, rnd, seen, want = str(tmp_path / "t"), random.Random(4), set(), []
    n = 0
    for number in range(4):
        rows = []
        for _ in range(120):
            n += 1
            # A third of all uploads is one file of one user.
            key = (1, "hot") if rnd.random() < 0.33 else (rnd.choice([1, 2, None]), rnd.choice([None, "", *[f"h{i}" for i in range(90)]]))
            rows.append((*key, datetime(2020 + number, 1, 1) + timedelta(minutes=n), n))
        batch = spark.createDataFrame(rows, SCHEMA)
        for key in {r[:2] for r in rows} - seen:
            want.append((key[0] or -1, key[1] or "", min(r[3] for r in rows if r[:2] == key)))
        seen |= {r[:2] for r in rows}
        L.store_first_uploads(batch, table, number, buckets=4)
        version = latest(spark, table)["version"]
        L.store_first_uploads(batch, table, number, buckets=4)  # a repeated batch
        assert latest(spark, table)["version"] == version
        assert stored(spark, table) == sorted(want)
    L.merge_filters(spark, table)
    assert spark.read.parquet(f"{table}/filters").count() <= 4
    L.store_first_uploads(batch, table, 9, buckets=4)
    assert stored(spark, table) == sorted(want)


def test_false_positives_and_failures_are_harmless(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    monkeypatch.setattr(L, "BITS", 1)  # filters that say yes to nearly everything
    rows = [(u, f"h{i}", datetime(2020, 1, 1), i) for u in (1, 2) for i in range(60)]
    L.store_first_uploads(spark.createDataFrame(rows[:60], SCHEMA), table, 0, buckets=2)
    batch = spark.createDataFrame(rows, SCHEMA)

    def fail(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(L, "append_version", fail)  # after the filters are written
        with pytest.raises(RuntimeError):
            L.store_first_uploads(batch, table, 1)
    named = batch.withColumn("upload_key", L.upload_key()).withColumn("bucket", L._bucket("upload_key", 2))
    assert L.possible_repeats(named, table).count() > 60
    L.store_first_uploads(batch, table, 1)
    assert stored(spark, table) == sorted((r[0], r[1], r[3]) for r in rows)


def test_as_a_stream(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: L.suppress_stream(stream_files(spark, str(tmp_path / "in"), "*.parquet", SCHEMA), str(tmp_path / "t"), str(tmp_path / "ck"), buckets=2).awaitTermination()
    put([(1, "a", datetime(2020, 1, 1), 1), (1, "a", datetime(2020, 1, 2), 2)])
    run()
    put([(1, "a", datetime(2024, 1, 1), 3), (2, "a", datetime(2024, 1, 1), 4)])
    run()
    run()
    assert stored(spark, str(tmp_path / "t")) == [(1, "a", 1), (2, "a", 4)]


def test_filter_of_many_keys(spark, tmp_path):
    """160,000 keys in one bucket: looking up each of 40,000 words among all would take minutes."""
    table, before = str(tmp_path / "t"), time.monotonic()
    keys = spark.range(0, 320_000).selectExpr("id % 7 AS user_id", "cast(id AS string) AS content_hash", "TIMESTAMP '2020-01-01' AS ts", "id AS n")
    L.store_first_uploads(keys.filter("n < 160000"), table, 0, buckets=1)
    row = spark.read.parquet(f"{table}/filters").first()
    assert row.words == len(row.bits) == 40_000
    named = keys.withColumn("upload_key", L.upload_key()).withColumn("bucket", L._bucket("upload_key", 1))
    assert L.possible_repeats(named.filter("n < 160000"), table).count() == 160_000
    assert L.possible_repeats(named.filter("n >= 160000"), table).count() < 1600
    assert time.monotonic() - before < 60


def test_new_keys_need_no_marks(spark, tmp_path):
    table = str(tmp_path / "t")
    for number in range(2):
        rows = [(u, "a", datetime(2020, 1, 1), u) for u in range(number * 10 + 1, number * 10 + 21)]
        L.store_first_uploads(spark.createDataFrame(rows, SCHEMA), table, number, buckets=2)
    assert stored(spark, table) == [(u, "a", u) for u in range(1, 31)]
    marks = [f"{table}/{m}" for m in latest(spark, table)["marks"]]
    assert not marks or not list(spark.read.option("recursiveFileLookup", "true").schema("upload_key string").parquet(*marks).take(1))
