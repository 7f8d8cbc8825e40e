"""Stored vector cells, searched in order of exact bounds (E2-E4 over a kept index).

Passages of an owner are kept by cell: a cap with a centre and the largest angle
of its members. No passage of a cell is nearer to a probe than the cap is, so a
probe that has its k best rows needs no cell whose cap is farther than the k-th.
Two rounds read what is needed: first the nearest cells that hold k rows, which
gives every probe a score to beat, then all other cells that may beat it. The
result is that of ``vector_search.nearest`` over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import require_columns
from ..functions.defaults import SECTION_BOOST
from ..functions.vectors import unit_rows
from ..session import materialise
from .metric_join import deal
from .vector_search import ProbeSet, _Running, vectors

CELL_ROWS = 2_000
#: Cells of one owner that a task compares with that owner's probes at once.
CELL_BLOCK = 4_096
#: Folders of the stored rows; a cell lies in one of them, sorted by owner and cell.
SLOTS = 64
#: Scores this close to a bound are looked at.
SLACK = 1e-9


def _caps(rows: DataFrame) -> DataFrame:
    """(user_id, cell, n, centre, radius) of dealt rows: the mean direction and the largest angle to it."""
    width = rows.filter("embedding IS NOT NULL").select(F.size("embedding").alias("d")).first()
    unit = F.transform("embedding", lambda x: x / F.sqrt(F.aggregate(
        "embedding", F.lit(0.0), lambda acc, y: acc + y.cast("double") * y.cast("double"))))
    means = rows.withColumn("unit", unit).groupBy("user_id", "cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(F.col("unit")[i]) for i in range(width["d"] if width else 0)]).alias("centre"))
    names = ["user_id", "cell", "n", "centre"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            if frame.empty:
                continue
            a, b = unit_rows(vectors(frame["embedding"])), unit_rows(vectors(frame["centre"]))
            angle = np.arccos(np.clip((a * b).sum(1), -1, 1))
            # A centre of zero length says nothing: its cap is the whole sphere.
            frame["angle"] = np.where(np.isnan(angle), np.pi, angle)
            yield pa.RecordBatch.from_pandas(frame[["cell", "angle"]], preserve_index=False)

    angles = rows.select("cell", "embedding").join(means.select("cell", "centre"), "cell").mapInArrow(
        work, "cell string, angle double").groupBy("cell").agg(F.max("angle").alias("radius"))
    return means.select(*names).join(angles, "cell")


def store_cells(pool: DataFrame, path: str, *, cell_rows: int = CELL_ROWS, slots: int = SLOTS) -> None:
    """Write ``pool`` (chunk_id, user_id, embedding, ...) as cells under ``path``: its rows and a table of caps.

    Rows whose vector is null, zero or not finite are left out: no probe finds them.
    """
    require_columns(pool, "chunk_id", "user_id", "embedding")
    fit = F.exists("embedding", lambda x: x != 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nobody = pool.select(F.col("chunk_id").alias("probe_id"), "user_id", "embedding").filter("false")
    dealt = materialise(deal(pool.filter(fit), nobody, 1.0, cell_rows=cell_rows)[0], "cells")
    slot = F.pmod(F.xxhash64("cell"), F.lit(slots)).cast("int")
    dealt.withColumn("slot", slot).repartition("slot").sortWithinPartitions("slot", "user_id", "cell").write.partitionBy(
        "slot").parquet(f"{path}/rows")
    _caps(dealt).withColumn("slot", slot).write.parquet(f"{path}/caps")


def _bounds(caps: DataFrame, probes: DataFrame, factor: float, pick: str) -> DataFrame:
    """(probe_id, cell, slot, n, bound) of the cells that a probe has to look at.

    ``pick="first"`` gives, for each block of cells, the nearest ones that hold
    top_k rows; ``pick="beating"`` all whose bound reaches the probe's ``score``.
    """
    blocks = caps.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / CELL_BLOCK).cast("int").alias("blocks"))
    left = caps.join(blocks, "user_id").withColumn("block", F.pmod(F.xxhash64("cell"), F.col("blocks")).cast("int")).drop("blocks")
    right = probes.join(blocks, "user_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    schema = StructType([StructField("probe_id", probes.schema["probe_id"].dataType), caps.schema["cell"], caps.schema["slot"],
                         caps.schema["n"], StructField("bound", DoubleType())])

    def work(cells: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {n: [] for n in schema.fieldNames()}
        if len(cells) and len(asked):
            cosines = unit_rows(vectors(asked["embedding"])) @ np.nan_to_num(unit_rows(vectors(cells["centre"]))).T
            angle = np.arccos(np.clip(cosines, -1, 1)) - cells["radius"].to_numpy()
            bound = np.cos(np.clip(angle, 0, np.pi))
            boosted = np.array([s is not None and len(s) > 0 for s in asked.get("sections", [None] * len(asked))])
            bound = np.where(boosted[:, None], np.maximum(bound, bound * factor), bound)
            held = cells["n"].to_numpy()
            for p in range(len(asked)):
                if np.isnan(bound[p]).any():
                    continue
                if pick == "first":
                    order = np.argsort(-bound[p], kind="stable")
                    before = np.cumsum(held[order]) - held[order]
                    take = order[before < asked["top_k"].iloc[p]]
                else:
                    take = np.flatnonzero(bound[p] >= asked["score"].iloc[p] - SLACK)
                out["probe_id"] += [asked["probe_id"].iloc[p]] * len(take)
                for name in ("cell", "slot", "n"):
                    out[name] += cells[name].iloc[take].tolist()
                out["bound"] += bound[p, take].tolist()
        return pd.DataFrame(out)

    keys = ["user_id", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, schema)


def _visit(rows: DataFrame, visits: DataFrame, probes: DataFrame, schema: StructType, factor: float) -> DataFrame:
    """The best rows of each visited cell for each of its visitors."""
    names = schema.fieldNames()
    asked = visits.select("probe_id", "cell").join(probes, "probe_id")
    wanted = visits.select("slot", "cell").distinct()
    parts = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / 1_000).cast("int").alias("parts"))
    held = rows.join(wanted, ["slot", "cell"], "left_semi").join(parts, "cell").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "slot")
    asked = asked.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("probe_id"), F.col("parts")).cast("int")).drop("parts")

    def work(block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if block.empty or some.empty:
            return pd.DataFrame({n: [] for n in names})
        running = _Running({0: ProbeSet(some.reset_index(drop=True))}, factor)
        running.add(block.assign(user_id=0))
        return pd.concat([*running.frames(names), pd.DataFrame({n: [] for n in names})][:1])

    keys = ["cell", "part"]
    return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(work, schema)


def search_cells(spark: SparkSession, path: str, probes: DataFrame, *, factor: float = SECTION_BOOST) -> tuple[DataFrame, DataFrame]:
    """The rows of ``nearest`` for ``probes`` over the cells under ``path``, and what was read for them.

    ``probes`` as in ``nearest``. The second table holds (probe_id, cells, read): the
    cells of the probe's owner and how many of them it looked at.
    """
    require_columns(probes, "probe_id", "user_id", "embedding", "top_k")
    probes = materialise(probes.filter(F.exists("embedding", lambda x: x != 0)), "cell-probes")
    owners = probes.select("user_id").distinct()
    caps = spark.read.parquet(f"{path}/caps").join(owners, "user_id", "left_semi")
    rows = spark.read.parquet(f"{path}/rows")
    schema = StructType([StructField("probe_id", probes.schema["probe_id"].dataType),
                         StructField("chunk_id", rows.schema["chunk_id"].dataType),
                         StructField("similarity", DoubleType()), StructField("score", DoubleType())])
    nearest_first = Window.partitionBy("probe_id").orderBy(F.desc("bound"), "cell")
    first = _bounds(caps, probes, factor, "first").withColumn(
        "before", F.sum("n").over(nearest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    first = materialise(first.join(probes.select("probe_id", "top_k"), "probe_id").filter("before < top_k").drop("top_k"), "visits")
    found = materialise(_visit(rows, first, probes, schema, factor), "found")
    best = Window.partitionBy("probe_id").orderBy(F.desc("score"), "chunk_id")
    kth = found.withColumn("rank", F.row_number().over(best)).join(probes.select("probe_id", "top_k"), "probe_id").filter(
        F.col("rank") == F.col("top_k")).select("probe_id", "score")
    open_probes = probes.join(kth, "probe_id", "left").withColumn("score", F.coalesce("score", F.lit(float("-inf"))))
    more = materialise(_bounds(caps, open_probes, factor, "beating").join(
        first.select("probe_id", "cell"), ["probe_id", "cell"], "left_anti"), "visits")
    found = found.union(_visit(rows, more, probes, schema, factor))
    ranked = found.withColumn("rank", F.row_number().over(best)).join(probes.select("probe_id", "top_k"), "probe_id")
    seen = first.select("probe_id").union(more.select("probe_id")).groupBy("probe_id").agg(F.count(F.lit(1)).alias("read"))
    cells = caps.groupBy("user_id").agg(F.count(F.lit(1)).alias("cells"))
    report = probes.select("probe_id", "user_id").join(cells, "user_id").join(seen, "probe_id").select("probe_id", "cells", "read")
    return ranked.filter(F.col("rank") <= F.col("top_k")).drop("top_k"), report
