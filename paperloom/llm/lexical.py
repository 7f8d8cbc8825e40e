"""Operator 13: the best documents for each item by exact integer scores, from posting lists cut into similar blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .arrays import mix

#: Items are ranked in blocks of at most so many bytes of text, which the driver and each task hold.
QUERY_BYTES = 1 << 18
#: Documents that one row of the index holds, and postings of a term that share a summary.
CHUNK, BLOCK = 2048, 32

#: Bytes that belong to terms, with A-Z lower-cased; every other byte is a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def forward(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): all of a document's terms counted, and those of ``words`` by number."""
    numbers = docs.sparkSession.sparkContext.broadcast(words)

    def work(batches):
        for batch in batches:
            found = numbers.value
            size, ids, counts = [], [], []
            for text in batch.column("text").to_pylist():
                terms = terms_of(text)
                size.append(len(terms))
                hits = np.fromiter((found.get(t, -1) for t in terms), np.int32, len(terms))
                which, times = np.unique(hits[hits >= 0], return_counts=True)
                ids.append(which.astype("<i4").tobytes())
                counts.append(times.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "n", "terms", "counts"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(work, "doc_id long, n long, terms binary, counts binary")


def totals(documents: DataFrame, n_words: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each word."""

    def count(batches):
        df = np.zeros(n_words, np.int64)
        for batch in batches:
            for terms in batch.column("terms").to_pylist():
                df[np.frombuffer(terms, "<i4")] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["word", "df"])

    n, length = documents.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_words, np.int64)
    counted = documents.select("terms").mapInArrow(count, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
    for row in counted.toLocalIterator():
        df[row["word"]] = row["df"]
    return n, length, df


def _signs(ids: np.ndarray, weights: np.ndarray) -> int:
    """32 signs of a weighted term vector against random directions; near vectors share their leading signs."""
    bits = (mix(ids.astype(np.uint64) + np.uint64(1))[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)
    side = (weights[:, None] * (2.0 * bits - 1)).sum(0)
    return int(((side > 0) * (1 << np.arange(31, -1, -1, dtype=np.int64))).sum())


def build_index(documents: DataFrame, n_docs: int, length: int, weight: np.ndarray, order: np.ndarray,
                partners: list[np.ndarray]) -> DataFrame:
    """Posting lists in blocks of similar documents, with summaries; one row per chunk of documents.

    ``order`` gives each word its place from the rarest on; words are named by
    it from here on. ``partners[w]`` are the words from w's place on that some
    item holds together with w: the coordinates of its summaries. Documents are
    sorted by the signs of their vectors, so a chunk holds similar ones; in each
    posting list of a chunk, ``BLOCK`` neighbours make a block, whose summary is
    the largest value of each coordinate over its documents.
    """
    shared = documents.sparkSession.sparkContext.broadcast((weight, order, partners))

    def place(batches):
        weights, places, _ = shared.value
        for batch in batches:
            codes, terms, values = [], [], []
            for n, ids, counts in zip(*[batch.column(c).to_pylist() for c in ("n", "terms", "counts")]):
                ids, tf = np.frombuffer(ids, "<i4"), np.frombuffer(counts, "<i4").astype(np.int64)
                m = 25 + (75 * n * n_docs) // length
                value = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
                codes.append(_signs(ids, weights[ids] * value.astype(float)))
                at = np.argsort(places[ids])
                terms.append(places[ids][at].astype("<i4").tobytes())
                values.append(value[at].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes, pa.int64()), batch.column("doc_id"), pa.array(terms, pa.binary()), pa.array(values, pa.binary())],
                ["code", "doc_id", "terms", "values"])

    def pack(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*[batch.column(c).to_pylist() for c in ("doc_id", "terms", "values")])
            while len(held) >= CHUNK:
                yield chunk(held[:CHUNK])
                held = held[CHUNK:]
        if held:
            yield chunk(held)

    def chunk(rows):
        partners = shared.value[2]
        ids = [np.frombuffer(t, "<i4") for _, t, _ in rows]
        sizes = np.array([len(i) for i in ids])
        terms, values = np.concatenate(ids), np.concatenate([np.frombuffer(v, "<i4") for _, _, v in rows])
        docs = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        words = np.unique(terms)
        grid = np.zeros((len(words), len(rows)), np.int32)
        grid[np.searchsorted(words, terms), docs] = values
        by_word = np.argsort(terms, kind="stable")
        lists = docs[by_word]
        ends = np.searchsorted(terms[by_word], words, "right")
        block_word, block_end, summary_size, summary_word, summary = [], [], [], [], []
        begin = 0
        for w, end in zip(words, ends):
            near = partners[w]
            at = np.searchsorted(words, near).clip(0, len(words) - 1)
            at = at[words[at] == near]
            for a in range(begin, end, BLOCK):
                b = min(end, a + BLOCK)
                top = grid[at[:, None], lists[a:b]].max(1)
                block_word.append(w)
                block_end.append(b)
                summary_size.append(np.count_nonzero(top))
                summary_word.append(words[at[top > 0]])
                summary.append(top[top > 0])
            begin = end
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
        cells = [np.array([-1 if d is None else d for d, _, _ in rows], "<i8"), np.array([d is None for d, _, _ in rows], np.uint8),
                 sizes.astype("<i4"), terms, values, lists, np.array(block_word, "<i4"), np.array(block_end, "<i4"),
                 np.array(summary_size, "<i4"), join(summary_word), join(summary)]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], COLUMNS)

    coded = documents.filter("length(terms) > 0").mapInArrow(place, "code long, doc_id long, terms binary, values binary")
    return materialise(coded.repartitionByRange("code", "doc_id").sortWithinPartitions("code", "doc_id").mapInArrow(
        pack, ", ".join(f"{c} binary" for c in COLUMNS)), "lexical")


COLUMNS = ["ids", "no_id", "sizes", "terms", "vals", "lists", "block_word", "block_end", "summary_size", "summary_word", "summary"]
_TYPES = dict.fromkeys(COLUMNS, "<i4") | {"ids": "<i8", "no_id": np.uint8}


class _Chunk:
    """One row of the index."""

    def __init__(self, row: dict):
        cells = {c: np.frombuffer(row[c], _TYPES[c]) for c in COLUMNS}
        self.ids, self.no_id, self.lists = cells["ids"], cells["no_id"], cells["lists"]
        self.block_word, self.block_end = cells["block_word"], cells["block_end"]
        self.begin = np.append(0, self.block_end[:-1])
        self.summary_key = (np.repeat(np.arange(len(self.block_word), dtype=np.int64), cells["summary_size"]) << 32) | cells["summary_word"]
        self.summary = cells["summary"].astype(np.int64)
        self.key = (np.repeat(np.arange(len(self.ids), dtype=np.int64), cells["sizes"]) << 32) | cells["terms"]
        self.value = cells["vals"].astype(np.int64)

    @staticmethod
    def cells(keys: np.ndarray, values: np.ndarray, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
        """values at (row, word), 0 where there is none."""
        wanted = (rows.astype(np.int64)[:, None] << 32) | words
        at = np.searchsorted(keys, wanted).clip(0, len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0)

    def best(self, words: np.ndarray, factor: np.ndarray, k: int, floor: int, counts: np.ndarray) -> list[tuple[int, bool, int]]:
        """(score, has id, doc id) of the documents that may be among the ``k`` best with at least ``floor``.

        Lists are walked from the rarest word on. A document is met first in the
        list of its rarest word, so the words from there on bound its score; a
        block is left out only if that bound is below the k-th best score so far.
        """
        a, b = np.searchsorted(self.block_word, words), np.searchsorted(self.block_word, words, "right")
        mine = np.concatenate([np.arange(x, y) for x, y in zip(a, b)]) if len(words) else np.zeros(0, np.int64)
        if not len(mine):
            return []
        bound = self.cells(self.summary_key, self.summary, mine, words) @ factor
        seen = np.zeros(len(self.ids), bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts[0] += len(mine)
        todo = np.argsort(-bound, kind="stable")
        at = 0
        while at < len(todo) and bound[todo[at]] >= max(floor, 1):
            step = todo[at : at + 16]
            step = mine[step[bound[step] >= max(floor, 1)]]
            at += 16
            counts[1] += len(step)
            new = np.unique(np.concatenate([self.lists[self.begin[x] : self.block_end[x]] for x in step]))
            new = new[~seen[new]]
            seen[new] = True
            if not len(new):
                continue
            docs = np.append(docs, new)
            scores = np.append(scores, self.cells(self.key, self.value, new, words) @ factor)
            if len(scores) >= k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                floor = max(floor, int(least))
                docs, scores = docs[scores >= least], scores[scores >= least]
        return [(int(s), bool(not self.no_id[d]), int(self.ids[d])) for d, s in zip(docs, scores) if s > 0]


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Terms are runs of letters and digits of ASCII and of any other characters,
    A-Z lower-cased. The score of a document is the sum over the item's terms,
    repeats included, of w * ((1000000000*tf) div (1000*tf + 8*m)) as stated in
    the README; it needs counts over all documents and is exact. Equal scores go
    by doc_id, documents without doc_id first. Null and empty texts have no terms;
    items without terms, or an empty table, give no rows. Repeated rows are so many
    documents or items, ranked alike. Other columns are not looked at. A long text
    is one row of counts.

    The items are a stated query set, taken in blocks of ``query_bytes`` of
    text; each block indexes all documents for its words.
    """
    spark = docs.sparkSession
    wanted = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    numbered = materialise(wanted.withColumn("item", F.monotonically_increasing_id()), "items")
    size = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / query_bytes))
    kept = docs.select("doc_id", "text")
    found = None
    for part in range(parts):
        rows = numbered.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).select("item", "text").collect()
        block = _rank_block(kept, {r["item"]: terms_of(r["text"]) for r in rows}, k)
        if block is not None:
            found = block if found is None else found.union(block)
    if found is None:
        found = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    return numbered.select("item", "item_id").join(found, "item").select("item_id", "rank", "doc_id", "score")


def _rank_block(docs: DataFrame, items: dict[int, list[bytes]], k: int) -> DataFrame | None:
    words = {w: i for i, w in enumerate(sorted({t for terms in items.values() for t in terms}))}
    if not words:
        return None
    documents = materialise(forward(docs, words), "forward")
    n_docs, length, df = totals(documents, len(words))
    if not n_docs:
        return None
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    by_df = np.lexsort((np.arange(len(df)), df))
    order = np.empty(len(df), np.int64)
    order[by_df] = np.arange(len(df))
    queries = {}
    partners: list[list[np.ndarray]] = [[] for _ in words]
    for item, terms in items.items():
        if terms:
            which, times = np.unique(order[[words[t] for t in terms]], return_counts=True)
            queries[item] = (which, times * weight[by_df[which]])
            for i, w in enumerate(which):
                partners[w].append(which[i:])
    near = [np.unique(np.concatenate(p)).astype(np.int32) for p in partners]
    index = build_index(documents, n_docs, length, weight, order, near)
    asked = docs.sparkSession.sparkContext.broadcast(queries)

    def search(batches):
        best: dict[int, list] = {item: [] for item in asked.value}
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row)
                counts = np.zeros(2, np.int64)
                for item, (which, factor) in asked.value.items():
                    floor = best[item][-1][0] if len(best[item]) >= k else 0
                    more = chunk.best(which, factor, k, floor, counts)
                    if more:
                        best[item] = sorted(best[item] + more, key=lambda x: (-x[0], x[1], x[2]))[:k]
        rows = [(item, i if has else None, s) for item, top in best.items() for s, has, i in top]
        if rows:
            item, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    tops = index.mapInArrow(search, "item long, doc_id long, score long").withColumn(
        "part", F.pmod(F.spark_partition_id(), F.lit(64)))
    ranked = ["score DESC", "doc_id ASC NULLS FIRST"]
    by = [F.expr(x.split(" ")[0]).desc() if "DESC" in x else F.col("doc_id").asc_nulls_first() for x in ranked]
    halfway = tops.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).filter(F.col("rank") <= k)
    return halfway.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(
        F.col("rank") <= k).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
