"""N-gram Jaccard join by token-combination prefixes (operator 4)."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrays import (from_planes, hash_runs, is_empty, lower_table, mix, planes, random_words, runs, spread, steps,
                     unused, width_of)
from .graph import components

#: White space of the word rule: words are runs of anything else.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = lower_table()

#: Shingles are 56-bit hashes; what a worker gathers before it sorts and sends, and characters per bucket.
TOKEN_BITS, TOKEN_BYTES, FLUSH, BUCKET_CHARS = 56, 7, 2 << 20, 16 << 20
#: A token in at most so many different sets is indexed alone, the next ones in pairs, the others in triples.
CLASS_LIMITS = (8, 128)


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each distinct shingle, by text and hash, and the size of each text's set."""
    low = _LOWER[raw]
    starts, ends, text = runs(~_BLANK[low], at)
    word = hash_runs(low, starts, ends)
    per_text = np.bincount(text, minlength=len(at) - 1)
    factor = random_words(k, 2)
    whole = len(word) - k + 1
    owners, hashes = [], []
    if whole > 0:
        inside = np.flatnonzero(text[:whole] == text[k - 1 :])
        sums = np.zeros(len(inside), np.uint64)
        for j in range(k):
            sums += word[inside + j] * factor[j]
        owners.append(text[inside])
        hashes.append(mix(sums + np.uint64(k)))
    short = np.flatnonzero((per_text > 0) & (per_text < k))
    if len(short):
        first = np.cumsum(per_text) - per_text
        sizes = per_text[short]
        index = spread(sizes, first[short])
        place = index - np.repeat(first[short], sizes)
        sums = np.add.reduceat(word[index] * factor[place], np.cumsum(sizes) - sizes)
        owners.append(short)
        hashes.append(mix(sums + sizes.astype(np.uint64)))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    owner, value = np.concatenate(owners), np.concatenate(hashes) >> np.uint64(64 - TOKEN_BITS)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))
    owner, value = owner[new], value[new]
    return owner, value, np.bincount(owner, minlength=len(at) - 1)


def set_ids(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit identifier of each set, from its size and the sum over its hashed members; 0 for empty sets."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        first = (np.cumsum(sizes) - sizes)[full]
        out[full] = mix(np.add.reduceat(mix(value + np.uint64(3)), first) + sizes[full].astype(np.uint64))
    return out


def text_sets(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_id, text_key), one row per row of ``docs``."""

    def work(batches):
        for batch in batches:
            sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for _, raw, at in steps(batch.column(1)):
                _, value, n = shingle_sets(raw, at, k)
                sizes.append(n)
                ids.append(set_ids(value, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(ids).view(np.int64)),
                 batch.column(2)],
                ["doc_id", "n_shingles", "set_id", "text_key"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    return picked.mapInArrow(
        work, f"doc_id {dict(picked.dtypes)['doc_id']}, n_shingles long, set_id long, text_key long")


def least_overlap(n, num: int, den: int):
    """Members a set of size ``n`` shares at least with any set it links to."""
    return -(-num * n // den)


def _block_rows(token, owner, sets, sizes, buckets: int):
    """One row for each bucket of token values: packed tokens, and the sets they come from."""
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    number = ((token >> np.uint64(TOKEN_BITS - 24)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    cut = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(token))
    for a, b in zip(cut[:-1], cut[1:]):
        part = np.diff(token[a:b], prepend=np.uint64(0))
        head, part[0] = int(part[0]), 0
        used, local = np.unique(owner[a:b], return_inverse=True)
        wide, narrow = width_of(part), max(1, (len(used).bit_length() + 7) // 8)
        yield (int(number[a]), head, planes(part, wide), wide, planes(local.astype(np.uint64), narrow), narrow,
               sets[used].tobytes(), sizes[used].astype("<u4").tobytes())


_BLOCKS = ("bucket int, head long, tokens binary, token_width int, owners binary, owner_width int, "
           "sets binary, sizes binary")


def token_blocks(docs: DataFrame, k: int, least: int, buckets: int, text: str = "text") -> DataFrame:
    """Tokens of all sets of at least ``least`` members, packed by bucket of their value."""

    def work(batches):
        names = [f.split()[0] for f in _BLOCKS.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        held, rows = [], 0

        def flush():
            token = np.concatenate([h[0] for h in held])
            base = np.cumsum([0] + [len(h[2]) for h in held[:-1]])
            owner = np.concatenate([h[1] + b for h, b in zip(held, base)])
            out = list(zip(*_block_rows(token, owner, np.concatenate([h[2] for h in held]),
                                        np.concatenate([h[3] for h in held]), buckets)))
            held.clear()
            for i in range(0, len(out[0]), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 64], t) for c, t in zip(out, kinds)], names)

        for batch in batches:
            for _, raw, at in steps(batch.column(0)):
                owner, value, n = shingle_sets(raw, at, k)
                big = n[owner] >= least
                if big.any():
                    held.append((value[big], owner[big], set_ids(value, n), n))
                    rows += int(big.sum())
                if rows >= FLUSH:
                    yield from flush()
                    rows = 0
        if held:
            yield from flush()

    return docs.select(F.col(text).alias("text")).mapInArrow(work, _BLOCKS)


def shared_tokens(blocks: DataFrame, buckets: int) -> DataFrame:
    """Tokens that at least two different sets have, with the number of these sets, packed by bucket of set."""

    def work(table: pa.Table) -> pa.Table:
        tokens, owners, sizes = [], [], []
        for row in table.to_pylist():
            part = from_planes(row["tokens"], row["token_width"])
            tokens.append(np.cumsum(part, dtype=np.uint64) + np.uint64(row["head"]))
            local = from_planes(row["owners"], row["owner_width"]).astype(np.int64)
            owners.append(np.frombuffer(row["sets"], np.uint64)[local])
            sizes.append(np.frombuffer(row["sizes"], "<u4")[local])
        token, owner, size = np.concatenate(tokens), np.concatenate(owners), np.concatenate(sizes)
        del tokens, owners, sizes
        order = np.lexsort((owner, token))
        token, owner, size = token[order], owner[order], size[order]
        new = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))
        token, owner, size = token[new], owner[new], size[new]
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        count = np.diff(np.append(begin, len(token)))
        often = np.repeat(count, count)
        keep = often > 1
        return _by_set(token[keep], owner[keep], size[keep], np.minimum(often[keep], 65535), buckets)

    return blocks.groupBy("bucket").applyInArrow(work, _SHARED)


_SHARED = "place int, sets binary, sizes binary, counts binary, tokens binary, often binary"


def _by_set(token, owner, size, often, buckets: int) -> pa.Table:
    order = np.argsort(owner, kind="stable")
    token, owner, size, often = token[order], owner[order], size[order], often[order]
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begin, len(owner)))
    sets = owner[begin]
    place = ((sets >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    ends = begin + counts
    rows = {name.split()[0]: [] for name in _SHARED.split(", ")}
    for number in np.unique(place):
        mine = np.flatnonzero(place == number)
        a, b = begin[mine[0]], ends[mine[-1]]
        rows["place"].append(int(number))
        rows["sets"].append(sets[mine].tobytes())
        rows["sizes"].append(size[begin[mine]].astype("<u4").tobytes())
        rows["counts"].append(counts[mine].astype("<u4").tobytes())
        rows["tokens"].append(planes(token[a:b], TOKEN_BYTES))
        rows["often"].append(often[a:b].astype("<u2").tobytes())
    return pa.table({n: pa.array(v, pa.int32() if n == "place" else pa.binary()) for n, v in rows.items()})


def size_classes(n: int, num: int, den: int) -> range:
    """Powers of two of the sizes that a set no larger than ``n`` and linked to it may have."""
    return range(int(least_overlap(n, num, den)).bit_length() - 1, int(n).bit_length())


def class_layout(s: int, num: int, den: int) -> int:
    """Parts that the frequent classes are cut into for sets of about ``2**s`` members; 0: all tokens go alone.

    A part of pairs wastes one token, a part of triples two. That must leave
    enough of what linked sets share, which very small sets under low
    thresholds cannot promise.
    """
    parts = max(1, (den - num) * (1 << s) // (4 * den))
    return parts if 3 * parts <= least_overlap(1 << s, num, den) - 1 else 0


def signatures(token: np.ndarray, often: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
    """Signatures of a set; two linked sets have one in common.

    ``token`` are the members that other sets have too, by rising number of sets
    and value, the order in which all sets take their prefix; members that no
    other set has come before them. The prefix grows until more tokens are
    covered than linked sets may miss. A token of a rare class covers one; of a
    part of a frequent class with k-token combinations, all but k - 1 are covered.
    """
    need = len(token) - int(least_overlap(n, num, den)) + 1
    kind = 1 + (often > CLASS_LIMITS[0]) + (often > CLASS_LIMITS[1])
    out = []
    for s in size_classes(n, num, den):
        parts = class_layout(s, num, den)
        k = kind if parts else np.ones(len(token), np.int64)
        part = np.where(k == 1, np.int64(-1), (token % np.uint64(max(1, parts))).astype(np.int64) * 4 + k)
        order = np.argsort(part, kind="stable")
        sorted_part = part[order]
        begin = np.flatnonzero(np.append(True, sorted_part[1:] != sorted_part[:-1]))
        nth = np.empty(len(token), np.int64)
        nth[order] = np.arange(len(token)) - np.repeat(begin, np.diff(np.append(begin, len(token))))
        covered = np.cumsum((part < 0) | (nth >= k - 1))
        end = int(np.searchsorted(covered, need)) + 1
        salt = np.uint64((s + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        alone = token[:end][part[:end] < 0]
        out.append(mix(alone + salt))
        for number in np.unique(part[:end][part[:end] >= 0]):
            inside = np.sort(token[:end][part[:end] == number])
            size = int(number) & 3
            if len(inside) >= size:
                chosen = np.array(list(itertools.combinations(range(len(inside)), size)))
                sums = np.zeros(len(chosen), np.uint64)
                for j in range(size):
                    sums = mix(sums + inside[chosen[:, j]] + np.uint64(j + 1))
                out.append(mix(sums + salt))
    return np.unique(np.concatenate(out))


def indexed_sets(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(set_id, n, tokens, signatures) of the sets that share enough tokens with others to link to any."""

    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]).astype(np.int64)
        owner = np.repeat(np.concatenate([np.frombuffer(r["sets"], np.uint64) for r in rows]), counts)
        size = np.repeat(np.concatenate([np.frombuffer(r["sizes"], "<u4") for r in rows]).astype(np.int64), counts)
        token = np.concatenate([from_planes(r["tokens"], TOKEN_BYTES) for r in rows])
        often = np.concatenate([np.frombuffer(r["often"], "<u2") for r in rows]).astype(np.int64)
        del rows
        order = np.lexsort((token, often, owner))
        owner, size, token, often = owner[order], size[order], token[order], often[order]
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        ends = np.append(begin[1:], len(owner))
        out = {"set_id": [], "n": [], "tokens": [], "signatures": []}
        for a, b in zip(begin, ends):
            n = int(size[a])
            if b - a >= least_overlap(n, num, den):
                out["set_id"].append(int(owner[a : a + 1].view(np.int64)[0]))
                out["n"].append(n)
                out["tokens"].append(planes(np.sort(token[a:b]), TOKEN_BYTES))
                out["signatures"].append(signatures(token[a:b], often[a:b], n, num, den).view(np.int64))
        return pa.table({"set_id": pa.array(out["set_id"], pa.int64()), "n": pa.array(out["n"], pa.int64()),
                         "tokens": pa.array(out["tokens"], pa.binary()),
                         "signatures": pa.array(out["signatures"], pa.list_(pa.int64()))})

    return shared.groupBy("place").applyInArrow(
        work, "set_id long, n long, tokens binary, signatures array<long>")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both) for pairs of set ids: the size of their whole intersection."""

    def work(batches):
        for batch in batches:
            both = [len(np.intersect1d(from_planes(left, TOKEN_BYTES), from_planes(right, TOKEN_BYTES), True))
                    for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(both, pa.int64())], ["a", "b", "both"])

    left = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
        work, "a long, b long, both long")


def link_sets(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) of the sets that link to another, by components.

    Sets with a common signature are candidates, unless their sizes and the
    number of members they share with anyone (``s``) rule a link out. The set of
    each signature with the fewest members of its own is its hub: of variants of
    one text that is the text itself. First each set is compared with its hubs;
    sets that come to lie in one component need no comparison of their own. What
    is left, sets of one hub but of different components, is compared pair by
    pair unless what each kept of the hub rules a link out.
    """
    size, common = F.col("n"), (F.length("tokens") / TOKEN_BYTES).cast("long").alias("s")
    marks = materialise(sets.select("set_id", "n", common, F.explode("signatures").alias("sig")), "marks")
    # Linked sets have at least num / (num + den) of their summed sizes in common.
    possible = (F.col("n") + F.col("m")) * num <= F.least("s", "o") * (num + den)
    hubs = marks.groupBy("sig").agg(
        F.min(F.struct((size - F.col("s")).alias("own"), "set_id", "n", "s")).alias("hub"), F.count("*").alias("c")
    ).filter("c > 1").select("sig", F.col("hub.set_id").alias("b"), F.col("hub.n").alias("m"), F.col("hub.s").alias("o"))
    members = materialise(marks.join(hubs, "sig").select(
        F.col("set_id").alias("a"), "b", "n", "s", "m", "o").distinct(), "members")
    compared = materialise(overlaps(members.filter((F.col("a") != F.col("b")) & possible).select("a", "b"), sets), "pairs")
    joined = members.join(compared, ["a", "b"], "left")
    linked = joined.filter(F.col("both") * den >= (F.col("n") + F.col("m") - F.col("both")) * num)
    links = materialise(linked.select("a", "b"), "links")
    roots = components(links)

    smallest = members.groupBy("b").agg(F.min("n").alias("least"))
    # The largest set that one with s shareable members can link to.
    reach = F.floor(F.col("s") * (num + den) / num) - size
    kept = F.when(F.col("a") == F.col("b"), F.col("s")).otherwise(F.col("both"))
    placed = joined.select("a", "b", "n", "s", kept.alias("kept")).join(smallest, "b").filter(
        reach >= F.col("least")).join(roots.withColumnRenamed("node", "a"), "a", "left")
    placed = materialise(placed.select(F.col("b").alias("hub"), "a", "n", "s", "kept",
                                       F.coalesce("root", "a").alias("root")), "placed")
    mixed = placed.groupBy("hub").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    left = placed.join(mixed.select("hub"), "hub", "left_semi")
    right = left.select("hub", F.col("a").alias("b"), F.col("n").alias("m"), F.col("s").alias("o"),
                        F.col("kept").alias("kept2"), F.col("root").alias("root2"))
    # Two sets share no more of the hub than either kept of it, and no more beyond it than either has there.
    both_known = F.col("kept").isNotNull() & F.col("kept2").isNotNull()
    shared = F.when(both_known, F.least("kept", "kept2") + F.least(F.col("s") - F.col("kept"), F.col("o") - F.col("kept2"))
                    ).otherwise(F.least("s", "o"))
    rest = left.join(right, "hub").filter(
        (F.col("a") < F.col("b")) & (F.col("root") != F.col("root2"))
        & ((F.col("n") + F.col("m")) * num <= shared * (num + den))).select("a", "b", "n", "m").distinct()
    rest = materialise(rest, "rest")
    more = overlaps(rest.select("a", "b"), sets).join(rest, ["a", "b"]).filter(
        F.col("both") * den >= (F.col("n") + F.col("m") - F.col("both")) * num).select("a", "b")
    more = materialise(more, "links")
    if is_empty(more):
        return roots
    return components(links.union(more))


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key), one row per row of ``docs``.

    A-Z is lower-cased; a document's set are its distinct shingles of ``k``
    words, or its whole word sequence where it has fewer. Two documents link when
    ``den`` times the intersection is at least ``num`` times the union;
    ``component_id`` is the smallest id reachable by links.

    Equal sets are one node, however many documents have them. Tokens (56-bit
    hashes of shingles) are counted over all sets in packed buckets. A token
    that only one set has can't be shared, so most sets are found to link to
    nothing before any join. The others take their prefix from the rarest shared
    token up; tokens of few sets are indexed alone, of more sets in pairs, of
    very many in triples, so that frequent passages make short lists. All
    candidates are verified on whole sets.

    Null and empty texts have an empty set and link with nothing. Repeated rows
    are equal sets. A null id never is a component's smallest, a component of
    null ids has a null ``component_id``. An empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    own = materialise(text_sets(docs, k, doc_id, text), "sets")
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // BUCKET_CHARS)
    # A set links to a different one only where one more or one less member is near enough.
    least = -(-num // (den - num)) if den > num else 1 << 62
    shared = shared_tokens(token_blocks(docs, k, least, buckets, text), buckets)
    sets = materialise(indexed_sets(shared, num, den), "indexed")
    roots = link_sets(sets, num, den)

    # One row a set, then one a component, written so that the joins below have plain sides that can be split.
    per_set = own.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    rooted = materialise(per_set.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "root", F.coalesce("root", "set_id")), "rooted")
    smallest = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = materialise(rooted.join(smallest, "root").select("set_id", "component_id"), "named")
    full = own.filter("n_shingles > 0").join(named, "set_id")
    return full.select("doc_id", "n_shingles", "component_id", "text_key").union(
        own.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key"))


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group, with all their columns, whatever their names.

    Null, empty and very long texts, null ids and empty tables are as in ``jaccard_groups``: texts without words stay.

    Rows repeated with the same id and text are merged where there are any.
    """
    groups = materialise(jaccard_groups(docs, k, num, den, doc_id, text), "groups")
    kid, kkey, key, copies = unused(docs, "kept_id", "kept_key", "text_key", "copies")
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias(kid), F.col("text_key").alias(kkey))
    keyed = docs.withColumn(key, F.xxhash64(text))
    out = keyed.join(kept, F.col(doc_id).eqNullSafe(F.col(kid)) & (F.col(key) == F.col(kkey)), "left_semi")
    if not is_empty(kept.groupBy(kid, kkey).agg(F.count("*").alias(copies)).filter(F.col(copies) > 1)):
        out = out.dropDuplicates([doc_id, key])
    return out.drop(key)
