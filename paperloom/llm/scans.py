"""Running sums and neighbours over a globally sorted table, without a task that holds a whole key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Sums are kept modulo 2^62, so that two of them can be added as longs.
MASK = (1 << 62) - 1


def sorted_scan(df: DataFrame, key: str, order: Sequence[str], sums: Sequence[str] = (), item: str | None = None) -> DataFrame:
    """``df`` with running sums and neighbours inside each value of ``key`` (a long that is never null).

    ``run_<c>`` is the sum, modulo 2^62, of ``c`` over the rows of the key up to
    this one in ``order``; ``before_`` and ``after_`` are ``item`` of the rows next
    to it, null at the ends of a key. Rows are range-partitioned by key and order,
    so that a key may stretch over many tasks; each task keeps one row and its
    sums, and one row per task goes through the driver to be carried on.
    """
    item = item or key
    names = df.columns
    rows = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    kind = dict(df.dtypes)[item]

    def work(batches):
        part, row = TaskContext.get().partitionId(), 0
        held, last_key, last_item, item_type = None, None, None, None
        total = np.zeros(len(sums), np.uint64)

        def out(table, after):
            return pa.Table.from_arrays(
                [*table.columns, pa.chunked_array([after])], [*table.column_names, "after_"]).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            fresh = np.append(last_key is None or keys[0] != last_key, keys[1:] != keys[:-1])
            starts = np.flatnonzero(fresh)
            number = np.searchsorted(starts, np.arange(len(keys)), "right") - 1
            columns, ends = list(batch.columns), []
            for j, name in enumerate(sums):
                run = np.cumsum(batch.column(name).to_numpy(zero_copy_only=False).astype(np.uint64))
                run = np.append(np.uint64(0), run)
                base = np.append(run[starts], np.uint64(0))[number]  # number is -1 before the first fresh row
                base[number < 0] = np.uint64(0)
                mine = run[1:] - base
                mine[number < 0] += total[j]
                total[j] = mine[-1]
                ends.append(pa.array((mine & np.uint64(MASK)).astype(np.int64)))
            items = batch.column(item)
            item_type = items.type
            before = pa.concat_arrays([pa.array([last_item], items.type), items.slice(0, len(keys) - 1)])
            before = pc.if_else(pa.array(~fresh), before, pa.scalar(None, items.type))
            count = np.arange(row, row + len(keys))
            table = pa.Table.from_arrays(
                [*columns, *ends, pa.array(np.full(len(keys), part, np.int32)), pa.array(count), before],
                [*batch.schema.names, *[f"run_{c}" for c in sums], "part_", "row_", "before_"])
            if held is not None:
                first = pa.array([items[0].as_py() if not fresh[0] else None], items.type)
                yield from out(held, first)
            after = pc.if_else(pa.array(~fresh[1:]), items.slice(1), pa.scalar(None, items.type))
            if len(keys) > 1:
                yield from out(table.slice(0, len(keys) - 1), after)
            held, last_key, last_item, row = table.slice(len(keys) - 1), keys[-1], items[-1].as_py(), row + len(keys)
        if held is not None:
            yield from out(held, pa.array([None], item_type))

    schema = ", ".join([*[f"{n} {t}" for n, t in df.dtypes], *[f"run_{c} long" for c in sums],
                        "part_ int", "row_ long", f"before_ {kind}", f"after_ {kind}"])
    done = materialise(rows.mapInArrow(work, schema), "scan")
    edges = done.groupBy("part_").agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.max("row_").alias("rows"),
        F.min_by(item, "row_").alias("head"), F.max_by(item, "row_").alias("tail"),
        *[F.max_by(f"run_{c}", "row_").alias(f"run_{c}") for c in sums]).orderBy("part_").collect()
    carried, total, before = [], [0] * len(sums), None
    for at, edge in enumerate(edges):
        same = before is not None and before["last"] == edge["first"]
        follows = at + 1 < len(edges) and edges[at + 1]["first"] == edge["last"]
        total = total if same else [0] * len(sums)
        carried.append((edge["part_"], edge["first"], edge["last"], edge["rows"], before["tail"] if same else None,
                        edges[at + 1]["head"] if follows else None, *total))
        own = [edge[f"run_{c}"] for c in sums]
        total = [(a + b) & MASK for a, b in zip(total, own)] if same and edge["first"] == edge["last"] else own
        before = edge
    spark = df.sparkSession
    carry = spark.createDataFrame(carried, ", ".join(
        ["part_ int", "c_first long", "c_last long", "c_rows long", f"c_before {kind}", f"c_after {kind}", *[f"c_{c} long" for c in sums]]))
    fixed = done.join(carry, "part_")
    return fixed.select(
        *names,
        *[F.when(F.col(key) == F.col("c_first"), (F.col(f"run_{c}") + F.col(f"c_{c}")).bitwiseAND(F.lit(MASK)))
          .otherwise(F.col(f"run_{c}")).alias(f"run_{c}") for c in sums],
        F.when(F.col("row_") == 0, F.col("c_before")).otherwise(F.col("before_")).alias("before_"),
        F.when(F.col("row_") == F.col("c_rows"), F.col("c_after")).otherwise(F.col("after_")).alias("after_"))
