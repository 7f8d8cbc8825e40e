"""Neighbours within an angle, by cells around pivots (D3).

Unit vectors lie on a sphere, where the angle is a metric. Candidates go to the
pivot nearest to them; a probe is sent to every cell that may hold a candidate
within the angle it looks for, and to no other: what is left out is left out by
the triangle inequality, so the result is exact. A cell with too many candidates
is split again around pivots of its own, and cells that no pivot splits, since
their vectors are equal, are cut by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import require_columns
from ..functions.vectors import best_rows, unit_rows
from ..session import materialise

CELL_ROWS = 20_000
#: Cells that one split makes at most.
FAN = 32
#: Angles this close to a limit are compared, whatever a bound says.
SLACK = 1e-6
#: Rows of either side that a task compares at once, and scores that exist at a time.
BLOCK_ROWS = 8_192
SLICE_SCORES = 2_000_000
#: A cell is split if the pairs that are left to compare are at most this share of its pairs.
GAIN = 0.25


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(values.reshape(len(column), -1))


def _by_cell(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch that share one set of pivots, and the pivots."""
    codes = batch.column("cell").dictionary_encode().indices.to_numpy()
    for code in np.unique(codes):
        rows = np.flatnonzero(codes == code)
        pivots = batch.column("pivots")[int(rows[0])].values
        yield rows, np.stack([p.values.to_numpy(zero_copy_only=False) for p in pivots]).astype(np.float64)


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*[f"{n} {t}" for n, t in df.dtypes], *more])


def _nearest_pivot(rows: DataFrame) -> DataFrame:
    """``rows`` (cell, embedding, pivots, ...) with the nearest pivot and the angle to it."""
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            child, angle = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at, pivots in _by_cell(batch):
                cosines = _matrix(batch.column("embedding").take(pa.array(at))) @ unit_rows(pivots).T
                child[at] = cosines.argmax(1)
                angle[at] = _angles(cosines.max(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(child), pa.array(angle)], [*names, "child", "angle"])

    return rows.mapInArrow(work, _schema(rows, "child int", "angle double"))


def _reachable(rows: DataFrame, widest: float) -> DataFrame:
    """``rows`` (cell, embedding, pivots, spans, ...) with the ``children`` that a partner within ``widest`` may lie in.

    For a pivot p whose candidates lie between two angles from it, a partner y of
    x has its angle to p within ``widest`` of x's. As y is nearer to p than to any
    other pivot o, x lies within ``widest`` of the half sphere of p against o.
    """
    names = [n for n in rows.columns if n not in ("pivots", "spans")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for at, pivots in _by_cell(batch):
                pivots = unit_rows(pivots)
                spans = batch.column("spans")[int(at[0])].as_py()
                cosines = _matrix(batch.column("embedding").take(pa.array(at))) @ pivots.T
                angles = _angles(cosines)
                home = cosines.argmax(1)
                for span in spans:
                    p = span["child"]
                    ok = (angles[:, p] <= widest + span["far"] + SLACK) & (angles[:, p] >= span["near"] - widest - SLACK)
                    apart = np.linalg.norm(pivots[home] - pivots[p], axis=1)
                    ahead = cosines[np.arange(len(at)), home] - cosines[:, p]
                    if widest < np.pi / 2:
                        ok &= ahead <= np.sin(widest) * apart + SLACK
                    for i in np.flatnonzero(ok):
                        lists[at[i]].append(p)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(lists, pa.list_(pa.int32()))], [*names, "children"])

    kept = rows.select(*names, "pivots", "spans")
    return kept.mapInArrow(work, ", ".join([*[f"{n} {t}" for n, t in kept.select(*names).dtypes], "children array<int>"]))


def _idle(reach: DataFrame, placed: DataFrame, gain: float) -> DataFrame:
    """(cell) of those whose split would leave more than ``gain`` of their pairs to compare."""
    visits = reach.select("cell", F.explode("children").alias("child")).groupBy("cell", "child").agg(F.count(F.lit(1)).alias("visits"))
    rows = placed.groupBy("cell", "child").agg(F.count(F.lit(1)).alias("n"), F.max("held").alias("held"))
    left = rows.join(visits, ["cell", "child"]).groupBy("cell").agg(
        F.sum(F.col("n").cast("double") * F.col("visits")).alias("left"), F.max("held").alias("held"))
    asked = reach.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
    return left.join(asked, "cell").filter(F.col("left") > gain * F.col("held") * F.col("asked")).select("cell")


def deal(candidates: DataFrame, probes: DataFrame, least: float, *, cell_rows: int = CELL_ROWS,
         fan: int = FAN, gain: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``cell``: each candidate in one, each probe in all that may hold a partner.

    No cell keeps more than ``cell_rows`` candidates, unless ``gain`` is given:
    then a cell stays whole where a split would send its probes to most parts of
    it and so copy them for little. Pivots are the candidates of a cell with the
    smallest hash of their row, so that every level draws others.
    """
    widest = float(np.arccos(np.clip(least, -1.0, 1.0)))
    start = F.col("user_id").cast("string").alias("cell")
    owners = candidates.groupBy("user_id").agg(F.count(F.lit(1)).alias("held"))
    if not owners.filter(F.col("held") > cell_rows).take(1):
        # Both sides may come from one table: new names keep their columns apart.
        return candidates.select("*", start), probes.select(*[F.col(c).alias(c) for c in probes.columns], start)
    here = materialise(candidates.select("*", start), "metric-cells")
    asked = materialise(probes.select("*", start), "metric-probes")
    done_cells, done_probes, level = [], [], 0
    while True:
        level += 1
        counts = here.groupBy("cell").agg(F.count(F.lit(1)).alias("held"))
        big = materialise(counts.filter(F.col("held") > cell_rows), "metric-big")
        done_cells.append(here.join(big, "cell", "left_anti"))
        done_probes.append(asked.join(big, "cell", "left_anti"))
        if not big.take(1):
            break
        own = here.join(big, "cell")
        draw = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(level), "chunk_id", "embedding"))
        pivots = own.select("cell", "embedding", F.row_number().over(draw).alias("n")).filter(F.col("n") <= fan).groupBy(
            "cell").agg(F.collect_set("embedding").alias("pivots"))
        pivots = materialise(pivots, "metric-pivots")
        placed = materialise(_nearest_pivot(own.join(pivots, "cell")).drop("pivots"), "metric-placed")
        spans = placed.groupBy("cell", "child").agg(
            F.min("angle").alias("near"), F.max("angle").alias("far"), F.count(F.lit(1)).alias("n"), F.max("held").alias("held"))
        spans = materialise(spans.groupBy("cell").agg(
            F.collect_list(F.struct("child", "near", "far")).alias("spans"), F.max(F.col("n") == F.col("held")).alias("whole"),
            F.ceil(F.max("held") / cell_rows).cast("int").alias("parts")), "metric-spans")
        reach = materialise(_reachable(asked.join(spans.filter("NOT whole"), "cell").join(pivots, "cell").drop("whole", "parts"), widest), "metric-reach")
        if gain is not None:
            stay = materialise(_idle(reach, placed, gain).union(spans.filter("whole").select("cell")), "metric-stay")
            done_cells.append(here.join(stay, "cell", "left_semi"))
            done_probes.append(asked.join(stay, "cell", "left_semi"))
            placed, reach, spans = (t.join(stay, "cell", "left_anti") for t in (placed, reach, spans))
        # A cell whose candidates all went to one pivot is cut by hash; its probes go to every part.
        stuck = spans.filter("whole").select("cell", "parts")
        part = F.pmod(F.xxhash64("chunk_id", F.lit(level)), F.col("parts"))
        cut = placed.join(stuck, "cell").withColumn("cell", F.concat_ws("#", "cell", part)).select(here.columns)
        cut_probes = asked.join(stuck, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn(
            "cell", F.concat_ws("#", "cell", "part")).select(asked.columns)
        moved = placed.join(stuck, "cell", "left_anti").withColumn("cell", F.concat_ws(".", "cell", "child")).select(here.columns)
        sent = reach.withColumn("child", F.explode("children")).withColumn("cell", F.concat_ws(".", "cell", "child")).select(asked.columns)
        here = materialise(moved.unionByName(cut), "metric-cells")
        asked = materialise(sent.unionByName(cut_probes), "metric-probes")
    cells, sides = done_cells[0], done_probes[0]
    for more in done_cells[1:]:
        cells = cells.unionByName(more)
    for more in done_probes[1:]:
        sides = sides.unionByName(more)
    return cells, sides


def cell_sizes(cells: DataFrame, probes: DataFrame) -> DataFrame:
    """(cell, n_candidates, n_probes) of dealt sides; their products are the pairs that are compared."""
    a = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n_candidates"))
    b = probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n_probes"))
    return a.join(b, "cell")


def nearest_within(candidates: DataFrame, probes: DataFrame, least: float, *, cell_rows: int = CELL_ROWS,
                   fan: int = FAN) -> DataFrame:
    """(probe_id, chunk_id, similarity): the best candidate of each probe with a cosine of at least ``least``.

    ``candidates``: chunk_id, user_id, paper_id, embedding and, where probes have
    ``before``, arrival. ``probes``: probe_id, user_id, embedding, skip_paper and
    optionally before. Ties go to the smaller chunk_id; probes without a partner
    give no row. Vectors that are null, zero or hold
    nulls or NaN have no partner; a chunk_id repeats a few times at most.
    """
    require_columns(candidates, "chunk_id", "user_id", "paper_id", "embedding")
    require_columns(probes, "probe_id", "user_id", "embedding", "skip_paper")
    timed = "before" in probes.columns
    some = F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    left = candidates.filter(some).select("chunk_id", "user_id", "paper_id", "embedding", *(["arrival"] if timed else []))
    right = probes.filter(some).select("probe_id", "user_id", "skip_paper", "embedding", *(["before"] if timed else []))
    cells, asked = deal(left, right, least, cell_rows=cell_rows, fan=fan, gain=GAIN)
    # Each side of a cell comes in blocks, and every block meets those of the other side.
    blocks = cell_sizes(cells, asked).select(
        "cell", F.ceil(F.col("n_candidates") / BLOCK_ROWS).cast("int").alias("parts"), F.ceil(F.col("n_probes") / BLOCK_ROWS).cast("int").alias("asking"))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = cells.join(blocks, "cell").withColumn("part", own("chunk_id", "parts")).withColumn("side", every("asking")).drop("parts", "asking")
    b = asked.join(blocks, "cell").withColumn("side", own("probe_id", "asking")).withColumn("part", every("parts")).drop("parts", "asking")
    schema = StructType([
        StructField("probe_id", probes.schema["probe_id"].dataType),
        StructField("chunk_id", candidates.schema["chunk_id"].dataType), StructField("similarity", DoubleType())])

    def compare(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"probe_id": [], "chunk_id": [], "similarity": []}
        if len(block) and len(wanted):
            matrix = unit_rows(np.stack(block["embedding"].to_numpy()).astype(np.float64))
            ids, papers = block["chunk_id"].to_numpy(), block["paper_id"].to_numpy()
            arrival = block["arrival"].to_numpy() if timed else None
            step = max(1, SLICE_SCORES // len(block))
            for at in range(0, len(wanted), step):
                some = wanted.iloc[at : at + step]
                sims = unit_rows(np.stack(some["embedding"].to_numpy()).astype(np.float64)) @ matrix.T
                ok = (sims >= least) & (papers[None, :] != some["skip_paper"].to_numpy()[:, None])
                if timed:
                    ok &= arrival[None, :] < some["before"].to_numpy()[:, None]
                for p in np.flatnonzero(ok.any(1)):
                    near = np.flatnonzero(ok[p])
                    # Copies of a vector are equal, whichever block they lie in.
                    equal = sims[p, near].round(12)
                    best = best_rows(equal, ids[near], 1)[0]
                    out["probe_id"].append(some["probe_id"].iloc[p])
                    out["chunk_id"].append(ids[near[best]])
                    out["similarity"].append(float(equal[best]))
        return pd.DataFrame(out)

    keys = ["cell", "part", "side"]
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(compare, schema)
    # Of equal similarities the smaller id counts.
    best = found.groupBy("probe_id").agg(F.min(F.struct((-F.col("similarity")).alias("off"), "chunk_id")).alias("best"))
    return best.select("probe_id", "best.chunk_id", (-F.col("best.off")).alias("similarity"))
