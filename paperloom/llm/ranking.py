"""Positions in a linked list that no task can hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: A list of at most this many elements is ranked by one task.
LAST = 1 << 14


def list_rank(arcs: DataFrame, last: int = LAST) -> DataFrame:
    """(a, pos) for ``arcs`` (a, pred, succ), elements of one doubly linked list; the head has position 0.

    Each round takes out the elements whose random priority is above those of
    both neighbours, about a third, and joins the neighbours by a link of the
    summed length: one shuffle of what is left. Once ``last`` elements remain, one
    task ranks them; then the elements taken out find their place from the one
    they led to, latest round first. In all, work grows with the list and rounds
    with its logarithm.
    """
    level = materialise(arcs.select("a", "pred", "succ", F.lit(1).cast("long").alias("w")), "list")
    taken, number = [], 0
    while level.count() > last:
        number += 1
        priority = [F.xxhash64(F.col(c), F.lit(number)) for c in ("a", "pred", "succ")]
        peak = F.col("pred").isNotNull() & F.col("succ").isNotNull() & (priority[0] > priority[1]) & (priority[0] > priority[2])
        gone = level.filter(peak)
        taken.append(gone.select("a", "succ", "w"))
        nothing = F.lit(None).cast("long")
        left = level.filter(~peak).select("a", "pred", "succ", "w", nothing.alias("p"), nothing.alias("s"))
        told = gone.select(F.explode(F.array(
            F.struct(F.col("pred").alias("a"), F.col("w").alias("w"), nothing.alias("p"), F.col("succ").alias("s")),
            F.struct(F.col("succ").alias("a"), F.lit(0).cast("long").alias("w"), F.col("pred").alias("p"), nothing.alias("s")),
        )).alias("e")).select("e.a", nothing.alias("pred"), nothing.alias("succ"), "e.w", "e.p", "e.s")
        level = materialise(left.union(told).groupBy("a").agg(
            F.coalesce(F.max("p"), F.max("pred")).alias("pred"), F.coalesce(F.max("s"), F.max("succ")).alias("succ"),
            F.sum("w").alias("w")), "list")

    def rank(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        a = table.column("a").to_numpy()
        order = np.argsort(a)
        succ = table.column("succ").fill_null(-1).to_numpy()
        at = np.where(succ < 0, len(a), order[np.searchsorted(a[order], succ).clip(0, len(a) - 1)])
        ahead, jump = np.append(np.where(succ < 0, 0, table.column("w").to_numpy()), 0), np.append(at, len(a))
        while (jump != len(a)).any():
            ahead, jump = ahead + ahead[jump], jump[jump]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(ahead[:-1].max() - ahead[:-1])], ["a", "pos"])

    known = materialise(level.select("a", "succ", "w").repartition(1).mapInArrow(rank, "a long, pos long"), "ranks")
    for gone in reversed(taken):
        found = gone.join(known.withColumnRenamed("a", "succ"), "succ").select("a", (F.col("pos") - F.col("w")).alias("pos"))
        known = known.union(materialise(found, "ranks"))
    return known
