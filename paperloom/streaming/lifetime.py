"""Uploads seen once are suppressed for ever (L5): filters of all stored keys decide which have to be looked up."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import _stored, materialise
from ..sources.sinks import _bucket
from ..sources.versions import BUCKETS, append_version, latest, read_versions
from .jobs import drop_staged

KEYS = ("user_id", "content_hash")
#: Bits a stored key takes in its bucket's filter, and places of them that it sets.
BITS, PROBES = 16, 5


def upload_key(keys=KEYS) -> Column:
    """One text for the values of a key; a null is a value of its own."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def _places(words: Column) -> list[Column]:
    """The bits of a key in a filter of ``words`` longs."""
    return [F.pmod(F.xxhash64("upload_key", F.lit(n)), words.cast("long") * 64) for n in range(PROBES)]


def _filters(keys: DataFrame) -> DataFrame:
    """(bucket, words, bits) of ``keys`` (upload_key, bucket): one bit array for each bucket."""
    size = keys.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) * BITS / 64).cast("int").alias("words"))
    placed = keys.join(size, "bucket").select("bucket", "words", F.explode(F.array(*_places(F.col("words")))).alias("at"))
    word = placed.select(
        "bucket", "words", F.floor(F.col("at") / 64).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bits"))
    # Every word gets a row, so that the sorted rows are the array and none is looked up.
    empty = size.select("bucket", "words", F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("word"), F.lit(0).cast("long").alias("bits"))
    word = word.unionByName(empty).groupBy("bucket", "words", "word").agg(F.bit_or("bits").alias("bits"))
    held = word.groupBy("bucket", "words").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("held"))
    return held.select("bucket", "words", F.col("held.bits").alias("bits"))


def _maybe() -> Column:
    """Whether a filter holds all bits of a key."""
    hit = F.lit(True)
    for at in _places(F.col("words")):
        word = F.get("bits", F.floor(at / 64).cast("int"))
        hit = hit & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return hit


def possible_repeats(batch: DataFrame, table: str) -> DataFrame:
    """(upload_key, bucket) of a batch that some filter of ``table`` may hold; all that are stored are among them."""
    spark = batch.sparkSession
    folder = f"{table}/filters"
    store, target = _stored(spark, folder)
    if not store.exists(target):
        return batch.select("upload_key", "bucket").filter("false")
    filters = spark.read.parquet(folder)
    return batch.select("upload_key", "bucket").join(filters, "bucket").filter(_maybe()).select("upload_key", "bucket").distinct()


def store_first_uploads(uploads: DataFrame, table: str, number: int, *, keys=KEYS, order=("ts",), buckets: int = BUCKETS,
                        source: str = "uploads") -> int:
    """Append the uploads whose key no batch before has brought; of equal keys in the batch the first by ``order``.

    Keys that no filter holds are new without a look at the table; the others
    meet the stored keys of their bucket. The batch's filters are written before
    its rows are committed: bits of a batch that failed only cost a look. A batch
    number that is committed already changes nothing.
    """
    spark = uploads.sparkSession
    state = latest(spark, table)
    if state and state["sources"].get(source, -1) >= number:
        return state["version"]
    buckets = state["buckets"] if state else buckets
    named = uploads.withColumn("upload_key", upload_key(keys))
    first = named.groupBy("upload_key").agg(F.min_by(F.struct(*uploads.columns), F.struct(*order)).alias("u"))
    first = materialise(first.select("upload_key", "u.*").withColumn("bucket", _bucket("upload_key", buckets)), "uploads")
    fresh = first
    if state:
        possible = possible_repeats(first, table)
        stored = read_versions(spark, table, "upload_key", keep_place=True).select("upload_key", "bucket")
        known = stored.join(possible, ["bucket", "upload_key"], "left_semi")
        fresh = first.join(known.select("upload_key"), "upload_key", "left_anti")
    fresh = materialise(fresh, "uploads")
    _filters(fresh.select("upload_key", "bucket")).write.mode("append").parquet(f"{table}/filters")
    # No fresh key is stored yet, so there is nothing to mark.
    version = append_version(fresh.drop("bucket"), table, "upload_key", buckets=buckets, source=(source, number),
                             marked=fresh.filter("false"))
    drop_staged(first, fresh)
    return version


def merge_filters(spark, table: str) -> None:
    """One filter a bucket again, over the stored keys; the old ones go once the new one is written."""
    stored = read_versions(spark, table, "upload_key", keep_place=True).select("upload_key", "bucket")
    store, old = _stored(spark, f"{table}/filters")
    _, new = _stored(spark, f"{table}/filters-{uuid.uuid4().hex}")
    _filters(stored).write.parquet(new.toString())
    store.delete(old, True)
    store.rename(new, old)


def suppress_stream(uploads: DataFrame, table: str, checkpoint: str, *, keys=KEYS, order=("ts",), buckets: int = BUCKETS):
    """The first upload of each key, for as long as the table lives; each trigger appends what is new."""
    def store(batch: DataFrame, number: int) -> None:
        store_first_uploads(batch, table, number, keys=keys, order=order, buckets=buckets, source=checkpoint)

    return uploads.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
