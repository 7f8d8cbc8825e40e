"""Operator 11: what conversations share from their first turn on, as a prefix trie measured by its Euler tour."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ranking import LAST, list_rank
from .scans import sorted_scan

#: Member ids of a node go to its hash in runs of this many.
RUN = 1 << 14
LANES = ("l0", "l1", "l2", "l3")
ROOT = -1


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n_chars) of every row that has a conv_id, without its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.char_length(text).cast("long").alias("n_chars"))


def shared_starts(conversations: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """(conv_id, part, place, digest, n_chars): conversations whose first turns come from their block's first one.

    Conversation c takes the first h turns of c - c % ``block``, where h is
    crc32(decimal c) % (``most`` + 1), and then its own turns after its first h.
    A row with part 0 and no digest stands for each conversation's empty start.
    """
    one = F.lit(1).cast("long").alias("one")
    rows = sorted_scan(
        _turns(conversations).select("*", one), "conv_id", ["turn", "role", "digest"], ["one"])
    rows = rows.select("conv_id", F.col("run_one").alias("place"), "digest", "n_chars")
    names = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    heads = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h")
    names = names.select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), heads)
    base = rows.filter((F.col("conv_id") % block == 0) & (F.col("place") <= most)).withColumnRenamed("conv_id", "base")
    taken = names.join(base, "base").filter("place <= h").select("conv_id", F.lit(1).alias("part"), "place", "digest", "n_chars")
    own = rows.select("*", heads).filter("place > h").select("conv_id", F.lit(2).alias("part"), "place", "digest", "n_chars")
    start = names.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"),
                         F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("n_chars"))
    return start.union(taken).union(own)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, l0..l3, p0..p3, n_chars, is_last): the start of a conversation up to each of its turns.

    ``l0..l3`` name the sequence of turns by 248 bits: the sum of SHA-256 of
    (depth, turn), which a scan adds up; ``p0..p3`` name it without its last turn.
    """
    one = F.lit(1).cast("long").alias("one")
    placed = sorted_scan(rows.select("*", one), "conv_id", ["part", "place"], ["one"])
    depth = (F.col("run_one") - 1).alias("depth")
    element = F.sha2(F.concat_ws(":", F.col("run_one").cast("string"), "digest"), 256)
    lanes = [F.when(F.col("digest").isNull(), F.lit(0)).otherwise(
        F.conv(F.substring(element, 1 + 16 * i, 15), 16, 10).cast("long")).cast("long").alias(f"e{i}") for i in range(4)]
    coded = placed.select("conv_id", depth, *lanes, "n_chars", F.col("after_").isNull().alias("is_last"))
    summed = sorted_scan(coded, "conv_id", ["depth"], ["e0", "e1", "e2", "e3"])
    before = [(F.col(f"run_e{i}") - F.col(f"e{i}")).bitwiseAND(F.lit((1 << 62) - 1)).alias(f"p{i}") for i in range(4)]
    return summed.select("conv_id", "depth", *[F.col(f"run_e{i}").alias(f"l{i}") for i in range(4)], *before, "n_chars", "is_last")


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, l0..l3, ends_sha256) of ``ends`` (depth, l0..l3, conv_id): ids ascending and joined by commas.

    Runs of ids are joined in parallel over sorted partitions; a hash is fed its
    runs one after the other, so that a node in which any number of conversations
    end costs one run of memory.
    """
    key = ["depth", *LANES]
    tasks = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")

    def join(batches):
        number = 0
        for batch in batches:
            rows, cells = batch.num_rows, batch.to_pydict()
            names = list(zip(*[cells[c] for c in key]))
            at = 0
            out = []
            while at < rows:
                end = at + 1
                while end < rows and end - at < RUN and names[end] == names[at]:
                    end += 1
                number += 1
                out.append((*names[at], cells["conv_id"][at], number, ",".join(map(str, cells["conv_id"][at:end]))))
                at = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*key, "conv_id", "run", "ids"])

    def digest(batches):
        now, feed = None, None
        for batch in batches:
            out = []
            cells = batch.to_pydict()
            for name, ids in zip(zip(*[cells[c] for c in key]), cells["ids"]):
                if name != now:
                    if now is not None:
                        out.append((*now, feed.hexdigest()))
                    now, feed = name, hashlib.sha256(ids.encode())
                else:
                    feed.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*key, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, feed.hexdigest())], [*key, "ends_sha256"])

    longs = ", ".join(f"{c} long" for c in key)
    runs = tasks.mapInArrow(join, f"{longs}, conv_id long, run long, ids string")
    # Equal first ids (a conversation ends once) do not occur, so the order is that of the runs.
    return runs.repartition(*[F.col(c) for c in key]).sortWithinPartitions(*key, "conv_id", "run").mapInArrow(
        digest, f"{longs}, ends_sha256 string")


def trie_nodes(starts: DataFrame, last: int = LAST) -> DataFrame:
    """One row per node of the prefix trie of ``starts`` (``prefixes``), with sums over its subtree.

    Enter and exit arcs of all nodes form one list, the Euler tour. The list is
    ranked, arcs are sorted by position, and what lies between a node's two arcs
    is its subtree: leaves and savings are differences of two prefix sums.
    """
    nodes = materialise(starts.groupBy("depth", *LANES).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars"),
        *[F.max(f"p{i}").alias(f"p{i}") for i in range(4)]).withColumn("node", F.monotonically_increasing_id()), "trie")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                         (F.col("depth") + 1).alias("depth"), *[F.col(f"l{i}").alias(f"p{i}") for i in range(4)])
    linked = materialise(nodes.filter("depth > 0").join(above, ["depth", "p0", "p1", "p2", "p3"]).select(
        "node", "conv_id", "parent", "parent_conv_id"), "trie")
    kids = linked.groupBy("parent").agg(
        F.count("*").alias("n_children"), F.min_by("node", "conv_id").alias("first"), F.max_by("node", "conv_id").alias("final"))
    beside = sorted_scan(linked, "parent", ["conv_id"], item="node").select(
        "node", "parent", "parent_conv_id", F.col("before_").alias("left"), F.col("after_").alias("right"))
    tree = materialise(
        nodes.join(beside, "node", "left").join(kids.withColumnRenamed("parent", "node"), "node", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        .withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
        .withColumn("saving", (F.col("n_convs") - 1) * F.col("n_chars")), "trie")
    enter, leave = (lambda c: 2 * F.col(c)), (lambda c: 2 * F.col(c) + 1)
    arcs = tree.select(F.explode(F.array(
        F.struct(enter("node").alias("a"), F.coalesce(leave("left"), enter("parent")).alias("pred"),
                 F.coalesce(enter("first"), leave("node")).alias("succ")),
        F.struct(leave("node").alias("a"), F.coalesce(leave("final"), enter("node")).alias("pred"),
                 F.coalesce(enter("right"), leave("parent")).alias("succ")))).alias("e")).select("e.*")
    places = list_rank(arcs, last).withColumn("node", F.shiftright("a", 1))
    valued = places.join(tree.select("node", "leaf", "saving"), "node").select(
        "node", "pos", F.lit(0).cast("long").alias("tour"), (F.col("a") % 2).alias("leaves"),
        *[F.when(F.col("a") % 2 == 0, F.col(c)).otherwise(0).alias(c) for c in ("leaf", "saving")])
    summed = sorted_scan(valued, "tour", ["pos"], ["leaf", "saving"])
    spans = summed.groupBy("node").agg(*[
        (F.max(F.when(F.col("leaves") == 1, F.col(f"run_{c}"))) - F.max(F.when(F.col("leaves") == 0, F.col(f"run_{c}") - F.col(c)))).alias(t)
        for c, t in (("leaf", "n_leaves"), ("saving", "saved_tokens"))])
    hashes = _end_hashes(starts.filter("is_last").select("depth", *LANES, "conv_id"))
    return tree.join(spans, "node").join(hashes, ["depth", *LANES], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, block: int = 100, most: int = 5, last: int = LAST) -> DataFrame:
    """Nodes of the prefix trie of ``conversations`` (conv_id, turn, role, text) with shared first turns.

    Turns are ordered by turn (null first), ties by role and then by the SHA-256 of
    role and text; equal rows are so many equal turns. A null role or text is
    empty; a turn is equal to another one if role and text are, so an empty turn
    counts as a turn. Rows without conv_id belong to no conversation. Other
    columns, whatever their names, are not looked at. An empty table has no nodes.
    Texts of any length take one hash each and do not move. A conversation or a
    node may hold any share of all rows: conversations, siblings and the tour are
    scanned over range partitions.
    """
    starts = materialise(prefixes(shared_starts(conversations, block, most)), "prefixes")
    return trie_nodes(starts, last)
