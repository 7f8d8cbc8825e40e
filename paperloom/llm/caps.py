"""Operator 12: near copies of vectors by spherical-cap filters."""

from __future__ import annotations

import functools
import math
import statistics

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .graph import components

#: Product codes, filters of each that a vector exceeds on average, filters two vectors must share
#: to be compared, and vectors of a label that exceed one filter on average.
CODES, FILTERS, SHARED, FULL = 6, 24, 2, 3
#: Blocks of coordinates of a product code.
PARTS = 4
#: Vectors of a ball that are compared at once.
SHARD = 1024
#: Angles closer to a limit than this are decided by comparing the vectors.
SLACK = 1e-7


@functools.cache
def _code(dim: int, words: int, code: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation to PARTS blocks, and ``words`` unit codewords for each of them."""
    rng = np.random.Generator(np.random.PCG64(12 + code))
    width = -(-dim // PARTS)
    turn = np.linalg.qr(rng.standard_normal((width * PARTS, width * PARTS)))[0][:dim]
    books = []
    for _ in range(PARTS):
        book = rng.standard_normal((words, width))
        books.append((book / np.linalg.norm(book, axis=1, keepdims=True)).T / math.sqrt(PARTS))
    return turn, books


def decode(vectors: np.ndarray, words: int, limit: float, code: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters of one code whose direction a unit vector exceeds by ``limit``.

    A direction is one codeword of each block; its number has one digit a block.
    Partial sums that cannot reach the limit with the best of the other blocks
    are left out, so that the list costs little more than its own length.
    """
    turn, books = _code(vectors.shape[1], words, code)
    turned = vectors @ turn
    width = turned.shape[1] // PARTS
    gains = [turned[:, i * width : (i + 1) * width] @ books[i] for i in range(PARTS)]
    rest = np.zeros((PARTS + 1, len(vectors)))
    for i in range(PARTS - 1, -1, -1):
        rest[i] = rest[i + 1] + gains[i].max(1)
    row, name, height = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for i in range(PARTS):
        grown = height[:, None] + gains[i][row]
        keep = np.nonzero(grown + rest[i + 1][row][:, None] >= limit)
        row, name, height = row[keep[0]], name[keep[0]] * words + keep[1], grown[keep]
    return row, name * CODES + code


def _highest(vectors: np.ndarray, words: int) -> np.ndarray:
    """The filter of the first code that a vector exceeds most."""
    turn, books = _code(vectors.shape[1], words, 0)
    turned, name = vectors @ turn, np.zeros(len(vectors), np.int64)
    width = turned.shape[1] // PARTS
    for i in range(PARTS):
        name = name * words + (turned[:, i * width : (i + 1) * width] @ books[i]).argmax(1)
    return name


def parameters(largest: int, dim: int) -> tuple[int, float]:
    """Codewords a block and the limit, for a label of ``largest`` vectors: caps shrink as labels grow."""
    share = min(0.02, FULL / max(largest, 1))
    words = max(2, math.ceil((FILTERS / share) ** (1 / PARTS)))
    return words, statistics.NormalDist().inv_cdf(1 - FILTERS / words**PARTS) / math.sqrt(dim)


def _valid(vector: Column) -> Column:
    number = vector.cast("array<double>")
    bad = F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(number, lambda x: x != 0), F.lit(False))


def _groups(batch: pa.RecordBatch, column: str):
    """(rows, matrix) of a binary column of doubles, for each length."""
    blobs = batch.column(column).to_pylist()
    sizes = np.array([len(b) // 8 for b in blobs])
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, np.frombuffer(b"".join(blobs[i] for i in rows), "<f8").reshape(len(rows), dim)


def _units(vectors: DataFrame) -> DataFrame:
    """(key, label, copies, unit): the different labelled vectors of ``vectors`` (key, label, vector) at length 1."""
    single = vectors.filter("key IS NOT NULL").groupBy("key").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"))

    def work(batches):
        for batch in batches:
            units = []
            for v in batch.column("vector"):
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                x = x / np.abs(x).max()
                units.append((x / np.sqrt(x @ x)).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), batch.column("copies"), pa.array(units, pa.binary())],
                ["key", "label", "copies", "unit"])

    return materialise(single.select("key", "label", "copies", "vector").mapInArrow(
        work, "key string, label string, copies long, unit binary").withColumn("uid", F.monotonically_increasing_id()), "units")


def _coded(units: DataFrame, words: int, limits: dict[int, float]) -> DataFrame:
    """``units`` with dim, cell (the highest filter) and filters."""

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            cells, lists, dims = np.zeros(n, np.int64), [b""] * n, np.zeros(n, np.int32)
            for rows, matrix in _groups(batch, "unit"):
                dims[rows] = matrix.shape[1]
                for a in range(0, len(rows), 256):
                    part = matrix[a : a + 256]
                    cells[rows[a : a + 256]] = _highest(part, words)
                    row, name = map(np.concatenate, zip(*[
                        decode(part, words, limits[matrix.shape[1]], c) for c in range(CODES)]))
                    by_row = np.argsort(row, kind="stable")
                    row, name = row[by_row], name[by_row]
                    cut = np.searchsorted(row, np.arange(len(part) + 1))
                    for i in range(len(part)):
                        lists[rows[a + i]] = name[cut[i] : cut[i + 1]]
            flat = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)),
                pa.array(np.concatenate([np.asarray(x, np.int64) for x in lists]) if n else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(dims), pa.array(cells), flat], [*batch.schema.names, "dim", "cell", "filters"])

    return materialise(units.mapInArrow(work, ", ".join(
        [*[f"{n} {t}" for n, t in units.dtypes], "dim int", "cell long", "filters array<long>"])), "coded")


def _centres(coded: DataFrame) -> DataFrame:
    """(label, dim, cell, centre): the mean direction of the vectors that share their highest filter."""
    key = ["label", "dim", "cell"]

    def fold(sums: dict, batch: pa.RecordBatch, blobs: str):
        cells = batch.to_pydict()
        for name, blob, n in zip(zip(*[cells[c] for c in key]), cells[blobs], cells["n"]):
            total = sums.get(name)
            if total is None:
                sums[name] = [np.frombuffer(blob, "<f8").copy(), n]
            else:
                total[0] += np.frombuffer(blob, "<f8")
                total[1] += n

    def out(sums: dict):
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()),
             pa.array([k[2] for k in sums], pa.int64()), pa.array([v.tobytes() for v, _ in sums.values()], pa.binary()),
             pa.array([n for _, n in sums.values()], pa.int64())], [*key, "total", "n"])

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            fold(sums, batch, "unit")
            if len(sums) > 1 << 14:
                yield out(sums)
                sums = {}
        if sums:
            yield out(sums)

    def whole(batches):  # sorted by key, a few rows a task each
        sums: dict = {}
        for batch in batches:
            fold(sums, batch, "total")
            if len(sums) > 1:
                *done, now = sums
                yield out({k: sums[k] for k in done})
                sums = {now: sums[now]}
        if sums:
            yield out(sums)

    schema = "label string, dim int, cell long, total binary, n long"
    sums = coded.select(*key, "unit", F.lit(1).cast("long").alias("n")).mapInArrow(partial, schema)
    return sums.repartition(*key).sortWithinPartitions(*key).mapInArrow(whole, schema).filter("n > 1").select(
        *key, F.col("total").alias("centre"))


def _balls(coded: DataFrame, widest: float) -> DataFrame:
    """``coded`` with ball, centre and angle: vectors within half of ``widest`` of their cell's centre share a ball.

    All vectors of a ball are linked with each other; any other vector is a ball of its own.
    """
    joined = coded.join(_centres(coded), ["label", "dim", "cell"], "left")
    names = coded.columns

    def work(batches):
        for batch in batches:
            units, centres = batch.column("unit").to_pylist(), batch.column("centre").to_pylist()
            near, mid = np.zeros(batch.num_rows), []
            inside = np.zeros(batch.num_rows, bool)
            for i, (u, c) in enumerate(zip(units, centres)):
                if c is not None:
                    c = np.frombuffer(c, "<f8")
                    size = np.sqrt(c @ c)
                    if size > 0:
                        angle = _angle(np.frombuffer(u, "<f8") @ (c / size))
                        if angle <= widest / 2 - SLACK:
                            inside[i], near[i] = True, angle
                            mid.append((c / size).tobytes())
                            continue
                mid.append(u)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(inside), pa.array(near), pa.array(mid, pa.binary())],
                [*names, "inside", "angle", "centre"])

    placed = materialise(joined.mapInArrow(work, ", ".join(
        [*[f"{n} {t}" for n, t in coded.dtypes], "inside boolean", "angle double", "centre binary"])), "placed")
    cells = ["label", "dim", "cell"]
    balls = placed.filter("inside").groupBy(*cells).agg(F.min("uid").alias("ball"))
    return placed.filter("inside").join(balls, cells).unionByName(
        placed.filter("NOT inside").withColumn("ball", F.col("uid")))


def _angle(cosine):
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def near_vectors(vectors: DataFrame, least: float = 0.93) -> tuple[DataFrame, DataFrame]:
    """(row per vector with key, ball, n_links; links between balls) of ``vectors`` (key, label, vector)."""
    widest = math.acos(least)
    units = _units(vectors)
    stats = units.groupBy(F.length("unit").alias("bytes")).agg(F.count("*")).collect()  # one row a vector length
    largest = units.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    words = parameters(largest, 1)[0]
    limits = {r["bytes"] // 8: parameters(largest, r["bytes"] // 8)[1] for r in stats}
    members = materialise(_balls(_coded(units, words, limits), widest), "members")
    balls = materialise(members.groupBy("ball").agg(
        F.first("centre").alias("centre"), F.max("angle").alias("radius"), F.sum("copies").alias("weight"),
        F.count("*").alias("size")), "balls")
    met = members.select("label", "dim", "ball", F.explode("filters").alias("filter")).distinct()
    left = met.withColumnRenamed("ball", "a")
    right = met.withColumnRenamed("ball", "b")
    pairs = left.join(right, ["label", "dim", "filter"]).filter("a < b").groupBy("a", "b").agg(
        F.count("*").alias("n")).filter(F.col("n") >= SHARED).select("a", "b")
    side = lambda s: balls.select(*[F.col(c).alias(f"{c}_{s}") for c in balls.columns]).withColumnRenamed(f"ball_{s}", s)

    def judge(batches):
        for batch in batches:
            c = batch.to_pydict()
            verdict = []
            for x, y, r, s, m, n in zip(*[c[k] for k in ("centre_a", "centre_b", "radius_a", "radius_b", "size_a", "size_b")]):
                cosine = float(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8"))
                angle = float(_angle(cosine))
                if m == n == 1 and not r and not s:
                    verdict.append(1 if cosine >= least else 0)
                elif angle + r + s <= widest - SLACK:
                    verdict.append(1)
                else:
                    verdict.append(0 if angle - r - s > widest + SLACK else 2)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in ("a", "b", "weight_a", "weight_b")], pa.array(verdict, pa.int32())],
                ["a", "b", "weight_a", "weight_b", "verdict"])

    judged = materialise(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(
        judge, "a long, b long, weight_a long, weight_b long, verdict int"), "judged").filter("verdict > 0")
    sure = judged.filter("verdict = 1")
    by_ball = sure.select(F.explode(F.array(
        F.struct(F.col("a").alias("ball"), F.col("weight_b").alias("n")),
        F.struct(F.col("b").alias("ball"), F.col("weight_a").alias("n")))).alias("e")).select("e.*")
    by_ball = by_ball.groupBy("ball").agg(F.sum("n").alias("of_ball"))
    open_pairs = judged.filter("verdict = 2").select("a", "b")
    by_vector, linked = _compare(open_pairs, members, least)
    counted = members.select("key", "uid", "ball").join(balls.select("ball", "weight"), "ball").join(
        by_ball, "ball", "left").join(by_vector, "uid", "left")
    rows = counted.select("key", "ball", (F.col("weight") - 1 + F.coalesce("of_ball", F.lit(0)) + F.coalesce(
        "of_vector", F.lit(0))).cast("long").alias("n_links"))
    return rows, sure.select("a", "b").union(linked)


def _compare(pairs: DataFrame, members: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Links of the vectors of two balls, for balls of which geometry alone does not decide: counts by uid, linked balls."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    salt = F.pmod(F.xxhash64("uid"), F.lit(64)).alias("salt")
    dealt = members.join(asked, "ball").select("ball", "uid", "copies", "unit", salt)
    shards = materialise(dealt.repartition("ball", "salt").sortWithinPartitions("ball").mapInArrow(
        _shard, "ball long, uids binary, weights binary, units binary"), "shards")
    side = lambda s: shards.select(*[F.col(c).alias(f"{c}_{s}") for c in shards.columns]).withColumnRenamed(f"ball_{s}", s)

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ua, ub = (np.frombuffer(row[f"uids_{s}"], "<i8") for s in "ab")
                wa, wb = (np.frombuffer(row[f"weights_{s}"], "<i8") for s in "ab")
                xa, xb = (np.frombuffer(row[f"units_{s}"], "<f8").reshape(len(u), -1) for s, u in (("a", ua), ("b", ub)))
                links = xa @ xb.T >= least
                na, nb = links @ wb, wa @ links
                uids, counts = np.append(ua[na > 0], ub[nb > 0]), np.append(na[na > 0], nb[nb > 0])
                if len(uids):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(uids), pa.array(counts.astype(np.int64)), pa.array(np.full(len(uids), row["a"])),
                         pa.array(np.full(len(uids), row["b"]))], ["uid", "n", "a", "b"])

    found = materialise(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(
        work, "uid long, n long, a long, b long"), "compared")
    return found.groupBy("uid").agg(F.sum("n").alias("of_vector")), found.select("a", "b").distinct()


def _shard(batches):
    """Vectors sorted by ball as packed rows of at most SHARD vectors of one ball."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("ball", "uid", "copies", "unit")]):
            if held and (len(held) == SHARD or held[0][0] != row[0]):
                yield _packed(held)
                held = []
            held.append(row)
    if held:
        yield _packed(held)


def _packed(rows):
    ball, uids, copies, units = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([ball[0]], pa.int64()), pa.array([np.array(uids, "<i8").tobytes()], pa.binary()),
         pa.array([np.array(copies, "<i8").tobytes()], pa.binary()), pa.array([b"".join(units)], pa.binary())],
        ["ball", "uids", "weights", "units"])


def vector_groups(embeddings: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings`` (vec_id, embedding, label).

    Rows of one label link when the cosine of their vectors, in double precision,
    is at least ``least``. Equal vectors are compared once and counted as often
    as they occur. Rows whose id or label is null, and vectors that are null,
    empty, zero or hold null or non-finite components, link with nothing; vectors
    of different lengths never link. Rows that repeat an id are vectors of their
    own. An empty table gives no rows; other columns are not looked at. A label, a
    vector or a group of near copies may hold any share of the rows.

    Vectors are compared if they exceed at least ``SHARED`` of the same filters;
    the README states the measured recall. Vectors around the mean of their
    highest filter are collapsed to balls in which all are linked; between balls
    the angles of the centres decide, and only where these do not, the vectors.
    """
    ok = _valid(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    vector = F.col("embedding").cast("array<double>")
    rows = materialise(embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vector.alias("vector"),
        F.when(ok, F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.transform(vector, lambda x: x.cast("string"))), 256))
        .alias("key")), "vectors")
    counted, links = near_vectors(rows.select("key", "label", "vector"), least)
    counted = materialise(counted, "counted")
    named = rows.select("vec_id", "key").join(counted, "key", "left")
    roots = components(links)
    smallest = named.filter("ball IS NOT NULL").groupBy("ball").agg(F.min("vec_id").alias("m")).join(
        roots.withColumnRenamed("node", "ball"), "ball", "left").select("ball", "m", F.coalesce("root", "ball").alias("root"))
    smallest = materialise(smallest, "roots")
    of_root = smallest.groupBy("root").agg(F.min("m").alias("component"))
    of_ball = smallest.join(of_root, "root").select("ball", "component")
    component = F.coalesce("component", "vec_id")
    return named.join(of_ball, "ball", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
