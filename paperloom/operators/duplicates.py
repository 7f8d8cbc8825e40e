"""Duplicate detection by hash, title, opening passage and catalogue title."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.columns import alnum_key, let
from ..functions.defaults import DUPLICATE_COSINE, DUPLICATE_TITLE
from ..functions.trigrams import jaccard, trigrams
from ..session import materialise
from .metric_join import nearest_within

#: Parities that stand for a title's trigrams, and pairs of titles that a task compares at a time.
BITS = 512
SLICE_PAIRS = 500_000


def exact_duplicates(papers: DataFrame) -> DataFrame:
    """Later arrivals of the same content in one library, with the first one.

    The first arrival is found by a map-side combined aggregate, so a group of
    copies is never gathered in one task.
    """
    first = papers.filter(F.col("content_hash").isNotNull()).groupBy("user_id", "content_hash").agg(
        F.min(F.struct("created_at", "paper_id")).alias("first")
    )
    return (
        papers.join(first, ["user_id", "content_hash"])
        .filter(F.col("paper_id") != F.col("first.paper_id"))
        .select("paper_id", "user_id", "content_hash", F.col("first.paper_id").alias("duplicate_of"))
    )


def _set_id() -> Column:
    # Sixteen bytes travel through the joins instead of the whole set.
    return F.unhex(F.md5(F.array_join("grams", "\u0001")))


def _title_sets(rows: DataFrame, id_col: str) -> DataFrame:
    """Distinct trigram sets per user with their two smallest ids."""
    grams = rows.select("user_id", F.col(id_col).alias("id"), trigrams(F.col("title")).alias("grams"))
    keyed = grams.filter(F.size("grams") > 0).withColumn("set_id", _set_id())
    order = Window.partitionBy("user_id", "set_id").orderBy("id")
    two = keyed.withColumn("rn", F.row_number().over(order)).filter("rn <= 2")
    return two.groupBy("user_id", "set_id").agg(
        F.first("grams").alias("grams"),
        F.min("id").alias("id_1"),
        F.max(F.when(F.col("rn") == 2, F.col("id"))).alias("id_2"),
    )


def _parities(sets: DataFrame) -> DataFrame:
    """``sets`` with ``bits``: of each of BITS classes of trigrams, by hash, whether a set holds an odd number."""
    names = [c for c in sets.columns if c != "grams"]
    places = F.transform("grams", lambda g: F.pmod(F.xxhash64(g), F.lit(BITS)).cast("int"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("places")
            rows = np.repeat(np.arange(len(held)) * BITS, held.value_lengths().to_numpy())
            odd = np.bincount(rows + held.flatten().to_numpy(), minlength=len(held) * BITS).reshape(-1, BITS) & 1
            bits = pa.array([row.tobytes() for row in np.packbits(odd.astype(np.uint8), axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], bits], [*names, "bits"])

    kept = sets.select(*names, places.alias("places"))
    return kept.mapInArrow(work, ", ".join([*[f"{n} {t}" for n, t in sets.select(*names).dtypes], "bits binary"]))


def _meetings(sets: DataFrame, threshold: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(user_id, n, cell, parts), and (user_id, cell, part, cell_2, part_2): the blocks of sets that have to meet.

    Cells are ranges of sizes, cut by hash into blocks where one size is frequent. Every two
    blocks of a user meet once, unless the sizes in one are too large for the other.
    """
    order = Window.partitionBy("user_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Counts by size, not sets, go through the window.
    sizes = sets.groupBy("user_id", "n").agg(F.count(F.lit(1)).alias("held")).withColumn(
        "cell", F.floor((F.sum("held").over(order) - F.col("held")) / block_rows).cast("int"))
    cells = sizes.groupBy("user_id", "cell").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.ceil(F.sum("held") / block_rows).cast("int").alias("parts"))
    placed = materialise(sizes.drop("held").join(cells, ["user_id", "cell"]), "title-cells")
    blocks = placed.select("user_id", "cell", "lo", "hi", "parts").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    other = blocks.select("user_id", F.col("cell").alias("cell_2"), F.col("part").alias("part_2"), F.col("lo").alias("lo_2"))
    after = (F.col("cell_2") > F.col("cell")) | ((F.col("cell_2") == F.col("cell")) & (F.col("part_2") >= F.col("part")))
    pairs = blocks.join(other, "user_id").filter(after & (F.col("hi") >= F.col("lo_2") * threshold - 1e-9))
    return placed.select("user_id", "n", "cell", "parts"), materialise(pairs.select("user_id", "cell", "part", "cell_2", "part_2"), "title-meetings")


def _candidates(sets: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(user_id, set_id, lib_set) of asked and stored sets whose sizes and parities do not rule the threshold out."""
    cells, pairs = _meetings(sets, threshold, block_rows)
    placed = sets.join(cells, ["user_id", "n"]).withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")).drop("parts")
    keys = ["user_id", "cell", "part", "cell_2", "part_2"]
    left = placed.join(pairs, ["user_id", "cell", "part"])
    # Both sides come from one table: new names keep their columns apart.
    named = [F.col(c).alias({"cell": "cell_2", "part": "part_2"}.get(c, c)) for c in placed.columns]
    right = placed.select(*named).join(pairs.select(*[F.col(k).alias(k) for k in keys]), ["user_id", "cell_2", "part_2"])
    schema = StructType([sets.schema["user_id"], StructField("set_id", BinaryType()), StructField("lib_set", BinaryType())])

    def words(frame: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(frame["bits"]), np.uint64).reshape(len(frame), -1).T.copy()

    def compare(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        asked, stored = [], []
        one, two = one.sort_values("n"), two.sort_values("n")
        a, b, n, m = words(one), words(two), one["n"].to_numpy(), two["n"].to_numpy()
        ids, other = one["set_id"].to_numpy(), two["set_id"].to_numpy()
        step = max(1, SLICE_PAIRS // max(1, len(two)))
        for at in range(0, len(one), step):
            rows = slice(at, at + step)
            fits = slice(np.searchsorted(m, n[rows][0] * threshold - 1e-9), np.searchsorted(m, n[rows][-1] / threshold + 1e-9, "right"))
            apart = np.zeros((len(n[rows]), len(m[fits])), np.uint16)
            for w in range(len(a)):
                apart += np.bitwise_count(a[w, rows, None] ^ b[w, None, fits])
            # Each class that differs stands for a trigram at least that only one of both sets holds.
            x, y = np.nonzero(apart <= (n[rows, None] + m[None, fits]) * ((1 - threshold) / (1 + threshold)) + 1e-9)
            x, y = x + at, y + fits.start
            ways = [(one, x, two, y, ids, other)]
            if key[1:3] != key[3:5]:
                ways.append((two, y, one, x, other, ids))
            for ask, i, lib, j, ask_ids, lib_ids in ways:
                ok = ask["is_ask"].to_numpy()[i] & lib["is_lib"].to_numpy()[j] & (ask_ids[i] != lib_ids[j])
                asked.append(ask_ids[i[ok]])
                stored.append(lib_ids[j[ok]])
        none = [np.empty(0, object)]
        return pd.DataFrame({"set_id": np.concatenate(asked or none), "lib_set": np.concatenate(stored or none)}).assign(user_id=key[0])[schema.names]

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)


def similar_titles(
    probes: DataFrame, library: DataFrame, threshold: float = DUPLICATE_TITLE, *, posting_rows: int = 5_000
) -> DataFrame:
    """The most similar other title of the same library, if at or above ``threshold``.

    ``probes``: probe_id, user_id, title. ``library``: paper_id, user_id, title.
    A probe that is itself in the library does not match itself.

    Exact set-similarity join: equal titles are first collapsed to one trigram set, and a
    set becomes BITS parities, of which two sets differ in no more than the trigrams that
    only one of them holds. Blocks of up to about ``posting_rows`` sets of neighbouring sizes
    meet and compare parities; the few candidates left are verified on the full sets.
    """
    lib = materialise(_title_sets(library, "paper_id"), "title-sets")
    keyed = probes.select("probe_id", "user_id", trigrams(F.col("title")).alias("grams")).filter(F.size("grams") > 0)
    keyed = materialise(keyed.withColumn("set_id", _set_id()), "title-probes")
    ask = keyed.groupBy("user_id", "set_id").agg(F.first("grams").alias("grams"))
    # A set is there once, whether it is asked for, stored or, as is usual, both.
    both = lib.select("user_id", "set_id", "grams", F.lit(True).alias("is_lib")).join(
        ask.select("user_id", "set_id", F.col("grams").alias("asked"), F.lit(True).alias("is_ask")), ["user_id", "set_id"], "full"
    ).withColumn("grams", F.coalesce("grams", "asked"))
    held = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    sets = materialise(_parities(both.select("user_id", "set_id", held("is_lib"), held("is_ask"), F.size("grams").alias("n"), "grams")), "title-parities")
    pairs = _candidates(sets, threshold, posting_rows)
    checked = (
        pairs.join(ask.select("user_id", "set_id", F.col("grams").alias("a")), ["user_id", "set_id"])
        .join(lib.select("user_id", F.col("set_id").alias("lib_set"), F.col("grams").alias("b"), "id_1"), ["user_id", "lib_set"])
    )
    # One evaluation per candidate: the verdict and the ranking come from the same value.
    match = let(
        jaccard(F.col("a"), F.col("b")),
        lambda s: F.when(s >= threshold, F.struct((-s).alias("col1"), F.col("id_1").alias("other"))),
    )
    best = checked.groupBy("user_id", "set_id").agg(F.min(match).alias("best"))
    same = lib.select("user_id", "set_id", "id_1", "id_2")
    twin = F.when(F.col("id_1") != F.col("probe_id"), F.col("id_1")).otherwise(F.col("id_2"))
    return (
        keyed.drop("grams").join(same, ["user_id", "set_id"], "left")
        .join(best, ["user_id", "set_id"], "left")
        .select(
            "probe_id",
            "user_id",
            F.coalesce(twin, F.col("best.other")).alias("similar_to"),
            F.when(twin.isNotNull(), F.lit(1.0)).otherwise(-F.col("best.col1")).alias("similarity"),
        )
        .filter("similar_to IS NOT NULL")
    )


def opening_duplicates(
    chunks: DataFrame, papers: DataFrame, threshold: float = DUPLICATE_COSINE, *, mode: str = "all", **options
) -> DataFrame:
    """D3: the paper whose opening passages are closest to this paper's first one.

    First passage of each paper against passages 0..2 of the owner's other
    papers; the best other paper is kept when it reaches ``threshold``.
    ``mode="earlier"`` compares only with papers created before. Only passages
    that the triangle inequality cannot keep apart are compared (``metric_join``).
    """
    own = papers.select("paper_id", F.col("user_id"), "created_at")
    vectors = chunks.drop("user_id").filter((F.col("chunk_index") < 3) & F.col("embedding").isNotNull()).join(own, "paper_id")
    candidates = vectors.select(
        F.col("paper_id").alias("chunk_id"), "paper_id", "user_id", "embedding", F.col("created_at").alias("arrival")
    )
    probes = vectors.filter("chunk_index = 0").select(
        F.col("paper_id").alias("probe_id"), "user_id", "embedding", F.col("paper_id").alias("skip_paper"),
        F.col("created_at").alias("before"),
    )
    if mode == "all":
        probes = probes.drop("before")
    return nearest_within(candidates, probes, threshold, **options).select(
        F.col("probe_id").alias("paper_id"), F.col("chunk_id").alias("duplicate_of"), "similarity"
    )


def attach_duplicates(papers: DataFrame, found: DataFrame) -> DataFrame:
    """D4, write side: put the duplicate flag on its paper."""
    return papers.drop("duplicate_of", "duplicate_similarity").join(
        found.select("paper_id", "duplicate_of", F.col("similarity").cast("float").alias("duplicate_similarity")),
        "paper_id",
        "left",
    )


def duplicate_warnings(papers: DataFrame) -> DataFrame:
    """D4, read side: the flag resolves only to a paper of the same owner."""
    other = papers.select(
        F.col("paper_id").alias("duplicate_of"), "user_id", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled paper")).alias("other_title")
    )
    return papers.select("paper_id", "user_id", "duplicate_of", "duplicate_similarity").join(
        other, ["duplicate_of", "user_id"], "left"
    ).select(
        "paper_id", "user_id",
        F.when(F.col("other_title").isNotNull(), F.col("duplicate_of")).alias("warning_paper"),
        "other_title",
        F.when(F.col("other_title").isNotNull(), F.col("duplicate_similarity")).alias("warning_similarity"),
    )


def merge_catalogue(works: DataFrame) -> DataFrame:
    """One record per normalised title, the most cited one, in first-seen order.

    ``works``: external_id, title, cited_by_count, position, ...; one aggregate
    with map-side combining. Records without a title stand for themselves.
    """
    key = alnum_key(F.coalesce("title", F.lit("")))
    keyed = works.withColumn("merge_key", F.when(key == "", F.concat(F.lit("id:"), "external_id")).otherwise(key))
    rank = F.struct(F.coalesce("cited_by_count", F.lit(0)), -F.col("position"))
    merged = keyed.groupBy("merge_key").agg(
        F.max_by(F.struct(*works.columns), rank).alias("w"), F.min("position").alias("first_position")
    )
    rest = [c for c in works.columns if c != "position"]
    return merged.select(*[F.col(f"w.{c}").alias(c) for c in rest], "first_position")
