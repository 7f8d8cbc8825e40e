"""Exact owner-scoped nearest passages for many probes at once.

The similarity of every (probe, candidate) of one owner is computed as a matrix
product inside the task and reduced there to the best ``top_k`` per probe, so
pairs never become rows. Two physical forms, same result:

* few probes (bytes measured): the probes are broadcast, candidates are scanned
  where they lie, and only ``top_k`` rows per task and probe are shuffled;
* many probes: both sides are cut into blocks of bounded size by hash, so an
  owner with a large share of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import require_columns
from ..functions.defaults import SECTION_BOOST
from ..functions.vectors import best_rows, unit_rows

# Optional probe columns and the candidate column each restricts.
EQUAL_FILTERS = {"want_project": "project_id", "want_paper": "paper_id", "want_year": "publication_year"}
BROADCAST_BYTES = 64 << 20  # of probe vectors as doubles
BLOCK_ROWS = 20_000
# Rows of a score matrix that exist at a time: with 20,000 probes 330 MB at most.
SLICE_ROWS = 2_000


def vectors(column) -> np.ndarray:
    """Vectors of a pandas column as one matrix of doubles."""
    width = len(column.iloc[0])
    return np.concatenate(column.to_numpy()).astype(np.float64, copy=False).reshape(len(column), width)


class ProbeSet:
    """The probes of one owner, as arrays."""

    def __init__(self, frame: pd.DataFrame):
        self.ids = frame["probe_id"].to_numpy()
        self.matrix = unit_rows(vectors(frame["embedding"]))
        self.keep = frame["top_k"].to_numpy()
        self.boost = [frozenset(s) if s is not None else frozenset() for s in frame.get("sections", [None] * len(frame))]
        self.wants = {
            c: frame[w].to_numpy() for w, c in EQUAL_FILTERS.items() if w in frame and frame[w].notna().any()
        }
        self.tags = frame["want_tag"].to_numpy() if "want_tag" in frame and frame["want_tag"].notna().any() else None
        self.skip = frame["skip_paper"].to_numpy() if "skip_paper" in frame else None
        self.before = frame["before"].to_numpy() if "before" in frame else None
        self.floor = frame["floor"].to_numpy() if "floor" in frame else None


def score_block(probes: ProbeSet, cand: pd.DataFrame, factor: float) -> Iterator[tuple]:
    """Yield (probe position, ids, similarities, scores) of the best rows of each slice of one block."""
    for at in range(0, len(cand), SLICE_ROWS):
        yield from _score_slice(probes, cand.iloc[at : at + SLICE_ROWS], factor)


def _score_slice(probes: ProbeSet, cand: pd.DataFrame, factor: float) -> Iterator[tuple]:
    matrix = unit_rows(vectors(cand["embedding"]))
    sims = matrix @ probes.matrix.T
    ids = cand["chunk_id"].to_numpy()
    sections = cand["section_type"].to_numpy() if "section_type" in cand else None
    for p in range(len(probes.ids)):
        sim = sims[:, p]
        score = sim
        if sections is not None and probes.boost[p]:
            score = np.where(np.isin(sections, list(probes.boost[p])), sim * factor, sim)
        ok = ~np.isnan(sim)
        for column, wanted in probes.wants.items():
            if not pd.isna(wanted[p]):
                ok &= cand[column].to_numpy() == wanted[p]
        if probes.tags is not None and not pd.isna(probes.tags[p]):
            ok &= np.fromiter((t is not None and probes.tags[p] in t for t in cand["tags"]), bool, len(cand))
        if probes.skip is not None:
            ok &= cand["paper_id"].to_numpy() != probes.skip[p]
        if probes.before is not None:
            ok &= cand["arrival"].to_numpy() < probes.before[p]
        if probes.floor is not None:
            ok &= sim >= probes.floor[p]
        if not ok.any():
            continue
        at = np.flatnonzero(ok)
        at = at[best_rows(score[at], ids[at], int(probes.keep[p]))]
        yield p, ids[at], sim[at], score[at]


def _packed(parts: list[tuple], probes: ProbeSet, names: list[str]) -> pd.DataFrame:
    if not parts:
        return pd.DataFrame({n: [] for n in names})
    return pd.DataFrame(
        {
            "probe_id": np.concatenate([np.repeat(probes.ids[p : p + 1], len(i)) for p, i, _, _ in parts]),
            "chunk_id": np.concatenate([i for _, i, _, _ in parts]),
            "similarity": np.concatenate([s for _, _, s, _ in parts]),
            "score": np.concatenate([s for _, _, _, s in parts]),
        }
    )


class _Running:
    """Best rows per (owner, probe) seen so far by one task."""

    def __init__(self, by_owner: dict, factor: float):
        self.by_owner, self.factor, self.best = by_owner, factor, {}

    def add(self, batch: pd.DataFrame) -> None:
        for owner, part in batch.groupby("user_id", sort=False):
            probes = self.by_owner.get(owner)
            if probes is None:
                continue
            for p, ids, sim, score in score_block(probes, part, self.factor):
                old = self.best.get((owner, p))
                if old is not None:
                    ids, sim, score = (np.concatenate(x) for x in zip(old, (ids, sim, score)))
                    at = best_rows(score, ids, int(probes.keep[p]))
                    ids, sim, score = ids[at], sim[at], score[at]
                self.best[(owner, p)] = (ids, sim, score)

    def frames(self, names: list[str]) -> Iterator[pd.DataFrame]:
        by_owner: dict = {}
        for (owner, p), (ids, sim, score) in self.best.items():
            by_owner.setdefault(owner, []).append((p, ids, sim, score))
        for owner, parts in by_owner.items():
            yield _packed(parts, self.by_owner[owner], names)


def nearest(
    candidates: DataFrame,
    probes: DataFrame,
    *,
    factor: float = SECTION_BOOST,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Best ``top_k`` candidates per probe: (probe_id, chunk_id, similarity, score, rank).

    ``candidates``: chunk_id, user_id, embedding and, when a probe uses them,
    section_type, paper_id, project_id, publication_year, tags, arrival.
    ``probes``: probe_id, user_id, embedding, top_k and optionally sections
    (boosted), want_project/want_paper/want_year/want_tag, skip_paper, before, floor.
    Candidates and probes without a vector have no neighbours.
    """
    require_columns(candidates, "chunk_id", "user_id", "embedding")
    require_columns(probes, "probe_id", "user_id", "embedding", "top_k")
    spark = candidates.sparkSession
    used = {"chunk_id", "user_id", "embedding"}
    used |= {"section_type"} if "sections" in probes.columns else set()
    used |= {c for w, c in EQUAL_FILTERS.items() if w in probes.columns}
    used |= {c for w, c in (("want_tag", "tags"), ("skip_paper", "paper_id"), ("before", "arrival")) if w in probes.columns}
    require_columns(candidates, *used)
    probes = probes.filter(F.col("embedding").isNotNull())
    cand = candidates.filter(F.col("embedding").isNotNull()).select(*sorted(used))
    schema = StructType(
        [
            StructField("probe_id", probes.schema["probe_id"].dataType),
            StructField("chunk_id", candidates.schema["chunk_id"].dataType),
            StructField("similarity", DoubleType()),
            StructField("score", DoubleType()),
        ]
    )
    names = schema.fieldNames()

    count, width = probes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if 8 * count * width <= broadcast_bytes:
        frame = probes.toPandas()
        # The counted probes stand in for their plan, which need not run again.
        keep_schema = StructType([probes.schema["probe_id"], probes.schema["top_k"]])
        keep = spark.createDataFrame(frame[["probe_id", "top_k"]].values.tolist(), keep_schema)
        shared = spark.sparkContext.broadcast(
            {owner: part.reset_index(drop=True) for owner, part in frame.groupby("user_id", sort=False)}
        )

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            running = _Running({o: ProbeSet(f) for o, f in shared.value.items()}, factor)
            out = to_arrow_schema(schema)
            for batch in batches:
                running.add(batch.to_pandas())
            for part in running.frames(names):
                yield pa.RecordBatch.from_pandas(part, schema=out, preserve_index=False)

        partial = cand.mapInArrow(scan, schema)
    else:
        partial = _blockwise(cand, probes, schema, factor, block_rows)
        keep = probes.select("probe_id", "top_k")

    order = Window.partitionBy("probe_id").orderBy(F.desc("score"), "chunk_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).join(keep, "probe_id")
    return ranked.filter(F.col("rank") <= F.col("top_k")).drop("top_k")


def _blockwise(cand: DataFrame, probes: DataFrame, schema: StructType, factor: float, block_rows: int) -> DataFrame:
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

    counts = blocks(cand, "n_c").join(blocks(probes, "n_p"), "user_id")
    left = (
        cand.join(counts, "user_id")
        .withColumn("cb", F.pmod(F.xxhash64("chunk_id"), F.col("n_c")).cast("int"))
        .withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("n_p") - 1)))
        .drop("n_c", "n_p")
    )
    right = (
        probes.join(counts, "user_id")
        .withColumn("pb", F.pmod(F.xxhash64("probe_id"), F.col("n_p")).cast("int"))
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("n_c") - 1)))
        .drop("n_c", "n_p")
    )
    names = schema.fieldNames()

    def one(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if block.empty or wanted.empty:
            return pd.DataFrame({n: [] for n in names})
        running = _Running({0: ProbeSet(wanted)}, factor)
        running.add(block.assign(user_id=0))
        return pd.concat([*running.frames(names), pd.DataFrame({n: [] for n in names})][:1])

    keys = ["user_id", "cb", "pb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(one, schema)
