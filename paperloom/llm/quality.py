"""Quality classifier: interpolated modified Kneser-Ney over characters, sharded count joins (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrays import from_planes, mix, planes, random_words, spread, unused, width_of
from .packing import pack_texts, unpack_texts

#: Order of the model; characters of one vectorised step; characters per bucket of documents.
ORDER, STEP_CHARS, BUCKET_CHARS = 5, 1 << 19, 20 << 20
#: Stands before a text's first character.
PAD = "\x02"
#: One of so many trusted documents is left out of the counts and sets the thresholds instead.
FOLDS = 5
#: Quantile of the trusted documents' scores beyond which a document is rejected.
QUANTILE = 0.995
#: Characters and documents that the common mean and the common quantile count for.
PRIOR_CHARS, PRIOR_DOCS = 60, 100
#: Characters of the window whose surprise is a text's peak; of the blocks, and the least of a block, whose share of
#: different grams is looked at.
PEAK_CHARS, BLOCK_CHARS, LEAST_BLOCK = 8, 256, 32
#: A text repeats itself when a block has less than this part of the different grams that trusted texts have at least.
REPEATING = 0.85
#: A peak is one place of a text and its quantile shaky where documents are few: this share of room for none, half of it
#: for ``PRIOR_DOCS``.
PEAK_ROOM = 0.2


def _bucket(doc_id: str, text: str, buckets: int):
    key = F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id))
    return F.pmod(key, F.lit(buckets)).cast("int")


def pack(docs: DataFrame, buckets: int, doc_id: str, text: str, lang: str) -> DataFrame:
    """Documents as compressed runs of texts, by bucket of their id."""
    return pack_texts(docs.select(
        _bucket(doc_id, text, buckets).alias("bucket"), F.col(doc_id).alias("doc_id"),
        F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")))


def unpack(table: pa.Table):
    """(ids, langs, keys, texts as code points, lengths) of packed rows."""
    for row, raw, sizes in unpack_texts(table):
        ends = np.cumsum(sizes)
        lead = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        yield row["doc_id"], row["lang"], row["text_key"], chars, lead[ends] - lead[ends - sizes]


def char_steps(chars: np.ndarray, lengths: np.ndarray):
    """(first document, padded code points, positions of real characters, their document) in bounded steps.

    A text longer than a step is cut into several, each after the characters that precede it.
    """
    ends = np.cumsum(lengths)
    row = 0
    while row < len(lengths):
        begin = int(ends[row] - lengths[row])
        last = max(row + 1, int(np.searchsorted(ends, begin + STEP_CHARS, "right")))
        sizes = lengths[row:last]
        if sizes.sum() <= STEP_CHARS:
            padded = np.full(int(sizes.sum()) + (ORDER - 1) * len(sizes), ord(PAD), np.uint64)
            first = np.cumsum(sizes + ORDER - 1) - sizes
            place = spread(sizes, first)
            padded[place] = chars[begin : begin + int(sizes.sum())]
            yield row, padded, place, np.repeat(np.arange(len(sizes)), sizes)
        else:
            whole = np.concatenate([np.full(ORDER - 1, ord(PAD), np.uint64), chars[begin : begin + int(sizes[0])]])
            for a in range(0, int(sizes[0]), STEP_CHARS):
                part = whole[a : a + STEP_CHARS + ORDER - 1].astype(np.uint64)
                place = np.arange(ORDER - 1, len(part))
                yield row, part, place, np.zeros(len(place), np.int64)
        row = last


def gram_keys(windows: np.ndarray, k: int, back: int = 0) -> np.ndarray:
    """64-bit keys of the ``k`` characters that end ``back`` places before the end of each window."""
    factor = random_words(ORDER, 10 + k)
    sums = np.full(len(windows), k, np.uint64)
    for j in range(k):
        sums += (windows[:, windows.shape[1] - 1 - back - j].astype(np.uint64) + np.uint64(1)) * factor[j]
    return mix(sums)


def whole_keys(padded: np.ndarray) -> np.ndarray:
    """The same keys of the ``ORDER`` characters that end at each position from the ``ORDER``-th on."""
    factor = random_words(ORDER, 10 + ORDER)
    n = len(padded) - ORDER + 1
    sums = np.full(n, ORDER, np.uint64)
    for j in range(ORDER):
        begin = ORDER - 1 - j
        sums += (padded[begin : begin + n] + np.uint64(1)) * factor[j]
    return mix(sums)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each different key, for every key the number of its place), without sorting.

    Keys are hashes; each writes its place into a table at its leading bits. Keys
    that find another's place there are sorted out among themselves.
    """
    bits = min(21, len(keys).bit_length() + 3)
    slots = (keys >> np.uint64(64 - bits)).astype(np.int64)
    table = np.empty(1 << bits, np.int32)
    here = np.arange(len(keys), dtype=np.int32)
    table[slots] = here
    place = table[slots]
    odd = np.flatnonzero(keys[place] != keys)
    if len(odd):
        _, first, back = np.unique(keys[odd], return_index=True, return_inverse=True)
        place[odd] = odd[first][back]
    chosen = np.zeros(len(keys), bool)
    chosen[place] = True
    return np.flatnonzero(chosen), (np.cumsum(chosen, dtype=np.int32) - 1)[place]


def string_keys(grams: list[str]) -> np.ndarray:
    """The same keys for strings of up to ``ORDER`` characters."""
    lengths = np.array([len(g) for g in grams], np.int64)
    chars = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4")
    last = np.cumsum(lengths) - 1
    out = np.zeros(len(grams), np.uint64)
    for k in range(1, ORDER + 1):
        mine = lengths == k
        out[mine] = gram_keys(chars[last[mine][:, None] + np.arange(1 - k, 1)], k)
    return out


def step_types(chars: np.ndarray, lengths: np.ndarray):
    """For each step of texts: (first document, keys and windows of its different grams, gram and document of each
    character)."""
    for row, padded, place, owner in char_steps(chars, lengths):
        if len(place):
            keys = whole_keys(padded)[place - ORDER + 1]
            where, back = distinct(keys)
            yield row, keys[where], padded[place[where][:, None] + np.arange(1 - ORDER, 1)].astype("<u4"), back, owner


class Types:
    """The different grams of a bucket: sorted keys and their characters."""

    def __init__(self):
        self.keys, self.windows, self.held, self.waiting = np.zeros(0, np.uint64), np.zeros((0, ORDER), "<u4"), [], 0

    def add(self, keys: np.ndarray, windows: np.ndarray) -> None:
        self.held.append((keys, windows))
        self.waiting += len(keys)
        if self.waiting > 1 << 20:
            self.settle()

    def wanted(self) -> np.ndarray:
        """Sorted keys of the grams that end at a character, and of their contexts."""
        # Shorter grams are few once each is counted once, so they are sorted by themselves.
        parts = [self.keys]
        for k in range(1, ORDER):
            parts += [np.unique(gram_keys(self.windows, k)), np.unique(gram_keys(self.windows, k, 1))]
        return np.unique(np.concatenate(parts))

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.held]])
        windows = np.concatenate([self.windows, *[w for _, w in self.held]])
        self.keys, first = np.unique(keys, return_index=True)
        self.windows, self.held, self.waiting = windows[first], [], 0


def train_counts(packed: DataFrame, trusted: DataFrame) -> DataFrame:
    """(gram, c): how often the trusted texts have each sequence of ``ORDER`` characters."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        good = set(right.column("doc_id").to_pylist())
        keys, counts, grams = [], [], []
        for ids, _, _, chars, lengths in unpack(left) if good else ():
            mine = np.array([i in good for i in ids], bool)
            first = np.cumsum(lengths) - lengths
            for _, key, windows, back, _ in step_types(chars[spread(lengths[mine], first[mine])], lengths[mine]):
                keys.append(key)
                counts.append(np.bincount(back))
                grams.append(windows)
        if not keys:
            return pa.table({"gram": pa.array([], pa.string()), "c": pa.array([], pa.int64())})
        key, where, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(back, np.concatenate(counts).astype(float)).astype(np.int64)
        text = np.ascontiguousarray(np.concatenate(grams)[where]).tobytes().decode("utf-32-le")
        return pa.table({"gram": pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string()),
                         "c": pa.array(total, pa.int64())})

    per_bucket = packed.groupBy("bucket").cogroup(trusted.groupBy("bucket")).applyInArrow(work, "gram string, c long")
    return per_bucket.groupBy("gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, float]:
    """(gram, alpha, gamma) of all orders and the probability that an unseen character gets.

    ``alpha`` is a gram's discounted share of its context, ``gamma`` what a
    context leaves to the next lower order. Lower orders count in how many
    different ways a gram is continued to the left. The three discounts of each
    order come from its counts of counts.
    """
    tables, grams = [], materialise(counts, "grams")
    uniform, rest = 1.0, 1.0
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            grams = grams.groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"))
        n1, n2, n3, n4, types, total = grams.agg(
            *[F.count_if(F.col("c") == j) for j in range(1, 5)], F.count("*"), F.sum("c")).first()
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        discount = [min(j, max(0.0, j - (j + 1) * y * b / a)) if a else j / 2
                    for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        off = F.when(F.col("c") == 1, discount[0]).when(F.col("c") == 2, discount[1]).otherwise(discount[2])
        if k == 1:
            lost = grams.agg(F.sum(off)).first()[0] or 0.0
            rest = lost / total if total else 1.0
            uniform = rest / ((types or 0) + 1)
            tables.append(grams.select("gram", ((F.col("c") - off) / F.lit(total or 1)).alias("alpha"),
                                       F.lit(None).cast("double").alias("gamma")))
            break
        parted = grams.withColumn("context", F.substring("gram", 1, k - 1))
        contexts = parted.groupBy("context").agg(F.sum("c").alias("n"), F.sum(off).alias("lost"))
        tables.append(parted.join(contexts, "context").select(
            "gram", ((F.col("c") - off) / F.col("n")).alias("alpha"), F.lit(None).cast("double").alias("gamma")))
        tables.append(contexts.select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("alpha"),
                                      (F.col("lost") / F.col("n")).alias("gamma")))
    union = tables[0]
    for t in tables[1:]:
        union = union.union(t)
    return union.groupBy("gram").agg(F.max("alpha").alias("alpha"), F.max("gamma").alias("gamma")), float(uniform)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def extremes(surprise: np.ndarray, grams: np.ndarray, sizes: np.ndarray, before: np.ndarray):
    """(largest mean surprise of ``PEAK_CHARS`` characters, smallest share of different grams in a block) by text.

    ``before`` holds the surprises just before the first text's, where that was cut.
    Only blocks of ``LEAST_BLOCK`` characters count; empty texts have (0, 1).
    """
    peak, fresh = np.zeros(len(sizes)), np.ones(len(sizes))
    some = sizes > 0
    if not some.any():
        return peak, fresh
    sizes = sizes[some]
    first = np.cumsum(sizes) - sizes
    end = np.arange(len(before) + 1, len(before) + 1 + len(surprise))
    least = end - PEAK_CHARS
    # Only the first characters of a text have a shorter window.
    for f, n in zip(first.tolist(), sizes.tolist()):
        start = f + len(before) if f else 0
        least[f : f + min(n, PEAK_CHARS)] = np.maximum(least[f : f + min(n, PEAK_CHARS)], start)
    sums = np.cumsum(np.concatenate([[0.0], before, surprise]))
    peak[some] = np.maximum.reduceat(sums[end] - sums[least], first) / PEAK_CHARS
    # Blocks are the rows of a grid; in a sorted row, different grams are changes of value.
    blocks = -(-sizes // BLOCK_CHARS)
    first_block = np.cumsum(blocks) - blocks
    held = np.full(int(blocks.sum()), BLOCK_CHARS)
    held[first_block + blocks - 1] = sizes - (blocks - 1) * BLOCK_CHARS
    grid = np.full(len(held) * BLOCK_CHARS, -1, np.int32)
    grid[spread(sizes, first_block * BLOCK_CHARS)] = grams
    grid = grid.reshape(len(held), BLOCK_CHARS)
    grid.sort(axis=1)
    share = ((grid[:, 1:] != grid[:, :-1]).sum(1) + (grid[:, 0] >= 0)) / held
    fresh[some] = np.minimum.reduceat(np.where(held >= LEAST_BLOCK, share, 1.0), first_block)
    return peak, fresh


def score(packed: DataFrame, model: DataFrame, unseen: float, shards: int, kind: str) -> DataFrame:
    """(doc_id, lang, text_key, n_chars, nats, peak, fresh): the summed surprise and the extremes of each text, per
    document row.

    Each bucket of documents asks the model's shards for its distinct grams;
    shards join them with their counts and send the two factors back in the
    order they were asked for.
    """

    def ask(table: pa.Table) -> pa.Table:
        types = Types()
        for _, _, _, chars, lengths in unpack(table):
            for _, key, windows, _, _ in step_types(chars, lengths):
                types.add(key, windows)
        types.settle()
        keys = types.wanted()
        number = shard_of(keys, shards)
        cut = np.append(np.flatnonzero(np.diff(number, prepend=-1)), len(keys))
        rows = {"shard": [], "bucket": [], "head": [], "width": [], "keys": []}
        for a, b in zip(cut[:-1], cut[1:]):
            step = np.diff(keys[a:b], prepend=keys[a])
            rows["shard"].append(int(number[a]))
            rows["bucket"].append(table.column("bucket")[0].as_py())
            rows["head"].append(int(keys[a : a + 1].view(np.int64)[0]))
            rows["width"].append(width_of(step))
            rows["keys"].append(planes(step, rows["width"][-1]))
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(
            rows.items(), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))})

    def keyed(batches):
        for batch in batches:
            keys = string_keys(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard_of(keys, shards), pa.int32()), pa.array(keys.view(np.int64)), batch.column(1),
                 batch.column(2)], ["shard", "key", "alpha", "gamma"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys = known.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys = np.append(keys[order], np.uint64(2**64 - 1))
        alpha = np.append(np.nan_to_num(known.column("alpha").to_numpy()[order].astype(float), nan=0.0), 0.0)
        gamma = np.append(np.nan_to_num(known.column("gamma").to_numpy()[order].astype(float), nan=1.0), 1.0)
        rows = {n: [] for n in ("bucket", "shard", "alpha", "gamma")}
        for r in asked.to_pylist():
            step = from_planes(r["keys"], r["width"])
            want = np.cumsum(step, dtype=np.uint64) + np.array([r["head"]], np.int64).view(np.uint64)
            place = np.searchsorted(keys, want)
            hit = keys[place] == want
            for n in ("bucket", "shard"):
                rows[n].append(r[n])
            rows["alpha"].append(np.where(hit, alpha[place], 0.0).astype("<f4").tobytes())
            rows["gamma"].append(np.where(hit, gamma[place], 1.0).astype("<f4").tobytes())
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(
            rows.items(), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))})

    def judge(texts: pa.Table, answers: pa.Table) -> pa.Table:
        runs = sorted(answers.to_pylist(), key=lambda r: r["shard"])
        alpha = np.concatenate([np.zeros(0, "<f4")] + [np.frombuffer(r["alpha"], "<f4") for r in runs])
        gamma = np.concatenate([np.zeros(0, "<f4")] + [np.frombuffer(r["gamma"], "<f4") for r in runs])
        del runs
        types, parts = Types(), []
        for ids, langs, marks, chars, lengths in unpack(texts):
            found = []
            for row, key, windows, back, owner in step_types(chars, lengths):
                types.add(key, windows)
                found.append((row, key, back, np.bincount(owner)))
            parts.append((ids, langs, marks, lengths, found))
        types.settle()
        # Shards are ranges of keys, so the answers in order of shards are those to the sorted keys.
        known = types.wanted()
        p = np.full(len(types.keys), unseen)
        for k in range(1, ORDER + 1):
            if k > 1:
                p *= gamma[np.searchsorted(known, gram_keys(types.windows, k - 1, 1))]
            p += alpha[np.searchsorted(known, types.keys if k == ORDER else gram_keys(types.windows, k))]
        surprise = -np.log(p)
        out = {"doc_id": [], "lang": [], "text_key": [], "n_chars": [], "nats": [], "peak": [], "fresh": []}
        for ids, langs, marks, lengths, found in parts:
            nats, peak, fresh = np.zeros(len(lengths)), np.zeros(len(lengths)), np.ones(len(lengths))
            last, tail = -1, np.zeros(0)
            for row, key, back, sizes in found:
                grams = np.searchsorted(types.keys, key).astype(np.int32)[back]
                each = surprise[grams]
                some = sizes > 0
                if some.any():
                    nats[row : row + len(sizes)][some] += np.add.reduceat(each, (np.cumsum(sizes) - sizes)[some])
                most, least = extremes(each, grams, sizes, tail if row == last else tail[:0])
                peak[row : row + len(sizes)] = np.maximum(peak[row : row + len(sizes)], most)
                fresh[row : row + len(sizes)] = np.minimum(fresh[row : row + len(sizes)], least)
                last, tail = row, each[1 - PEAK_CHARS :]
            out["doc_id"] += ids
            out["lang"] += langs
            out["text_key"] += marks
            out["n_chars"] += lengths.tolist()
            out["nats"] += nats.tolist()
            out["peak"] += peak.tolist()
            out["fresh"] += fresh.tolist()
        kinds = (texts.schema.field("doc_id").type.value_type, pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 3)
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds)})

    asked = packed.groupBy("bucket").applyInArrow(ask, "shard int, bucket int, head long, width int, keys binary")
    shard_rows = model.mapInArrow(keyed, "shard int, key long, alpha double, gamma double")
    answers = asked.groupBy("shard").cogroup(shard_rows.groupBy("shard")).applyInArrow(
        answer, "bucket int, shard int, alpha binary, gamma binary")
    return packed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
        judge, f"doc_id {kind}, lang string, text_key long, n_chars long, nats double, peak double, fresh double")


def classify_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, doc_id: str = "doc_id",
                     text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, text_key, n_chars, perplexity, score, threshold, peak, peak_limit, fresh, fresh_limit, keep), one row per
    row of ``docs``.

    Trusted texts are those labelled quality 1 and never toxic. Four fifths of
    them are counted, all of their characters. ``score`` is a text's mean
    surprise per character, drawn towards its language's median as if
    ``PRIOR_CHARS`` more characters had that, so that a few odd characters do not
    condemn a short text. A text is rejected when its score exceeds the
    ``quantile`` of the trusted documents that were not counted, of its language;
    a language with few of these leans on the quantile of all. ``peak`` is the mean
    surprise of a text's worst ``PEAK_CHARS`` characters, which a few foreign words
    raise in a text of any length, and has a limit of the same kind, with some room where documents are few. ``fresh`` is the
    smallest share of different grams in a block of a text, which a loop of likely
    words lowers; below ``REPEATING`` times the opposite quantile a text is rejected.

    Null and empty texts can't be judged and are kept, with null figures. A null
    language is a language of its own. Without trusted texts everything is kept.
    Repeated rows are judged alike; a null id has no label. Empty tables give no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    # Larger buckets have fewer grams to ask for, so their number follows the text alone.
    buckets = 8 + chars // BUCKET_CHARS
    trusted = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast(kind).alias("doc_id")).agg(
        F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and coalesce(t, 0) = 0")
    trusted = trusted.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)) == 0).alias("held"),
                             F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"))
    packed = pack(docs, buckets, doc_id, text, lang)
    model, unseen = kneser_ney(train_counts(packed, trusted.filter("not held").select("bucket", "doc_id")))
    model = materialise(model, "model")
    scored = materialise(score(packed, model, unseen, buckets, kind), "scored").withColumn(
        "lang", F.coalesce("lang", F.lit("")))
    per_char = F.try_divide("nats", "n_chars")

    held = scored.filter("n_chars > 0").join(trusted.filter("held").select("doc_id"), "doc_id", "left_semi")
    held = materialise(held.select("lang", "n_chars", per_char.alias("h"), "peak", "fresh"), "held")
    middle, middle_peak = held.agg(*[F.percentile_approx(c, 0.5, 10000) for c in ("h", "peak")]).first()
    if middle is None:
        return scored.select("doc_id", "text_key", "n_chars", F.exp(per_char).alias("perplexity"),
                             per_char.alias("score"), F.lit(None).cast("double").alias("threshold"),
                             "peak", F.lit(None).cast("double").alias("peak_limit"), "fresh",
                             F.lit(None).cast("double").alias("fresh_limit"), F.lit(True).alias("keep"))
    per_lang = held.groupBy("lang").agg(F.percentile_approx("h", 0.5, 10000).alias("mid"),
                                          F.percentile_approx("peak", 0.5, 10000).alias("mid_peak"),
                                          F.count("*").alias("docs"))

    def drawn(rows: DataFrame, h) -> DataFrame:
        joined = rows.join(per_lang, "lang", "left")
        # A language with few held-out texts leans on the middle of all, as its quantile does.
        few = F.coalesce("docs", F.lit(0))
        mid = (F.coalesce("mid", F.lit(middle)) * few + F.lit(middle) * 10) / (few + 10)
        mid_peak = (F.coalesce("mid_peak", F.lit(middle_peak)) * few + F.lit(middle_peak) * 10) / (few + 10)
        joined = joined.withColumns({"mid": mid, "mid_peak": mid_peak})
        return joined.withColumn("score", (h * F.col("n_chars") + F.col("mid") * PRIOR_CHARS)
                                 / (F.col("n_chars") + PRIOR_CHARS))

    excess = drawn(held, F.col("h")).select(
        "lang", (F.col("score") - F.col("mid")).alias("over"), (F.col("peak") - F.col("mid_peak")).alias("above"), "fresh")
    bounds = (("over", quantile), ("above", quantile), ("fresh", 1 - quantile))
    common = excess.agg(*[F.percentile_approx(c, q, 10000).alias(c) for c, q in bounds]).first()
    limits = excess.groupBy("lang").agg(
        *[F.percentile_approx(c, q, 10000).alias(f"own_{c}") for c, q in bounds], F.count("*").alias("seen"))
    judged = drawn(scored, F.when(F.col("n_chars") > 0, per_char)).join(limits, "lang", "left")
    seen = F.coalesce("seen", F.lit(0))

    def bound(c: str):
        return (F.coalesce(f"own_{c}", F.lit(common[c])) * seen + F.lit(common[c]) * PRIOR_DOCS) / (seen + PRIOR_DOCS)

    judged = judged.withColumns({"threshold": F.col("mid") + bound("over"),
                                 "peak_limit": F.col("mid_peak") + bound("above") * (
                                     1 + PEAK_ROOM * PRIOR_DOCS / (seen + PRIOR_DOCS)),
                                 "fresh_limit": bound("fresh") * REPEATING})
    fits = (F.col("score") <= F.col("threshold")) & (F.col("peak") <= F.col("peak_limit")) & (
        F.col("fresh") >= F.col("fresh_limit"))
    real = F.col("n_chars") > 0
    return judged.select(
        "doc_id", "text_key", "n_chars", F.when(real, F.exp(per_char)).alias("perplexity"), "score", "threshold",
        F.when(real, F.col("peak")).alias("peak"), "peak_limit", F.when(real, F.col("fresh")).alias("fresh"), "fresh_limit",
        (~real | F.coalesce(fits, F.lit(True))).alias("keep"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, whatever their names.

    Null, empty, repeated and very long texts, null ids and empty tables are judged as ``classify_quality`` says.
    """
    gid, gkey, key = unused(docs, "gone_id", "gone_key", "text_key")
    gone = classify_quality(docs, labels, doc_id=doc_id, text=text, lang=lang).filter("not keep").select(
        F.col("doc_id").alias(gid), F.col("text_key").alias(gkey)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(text))
    return keyed.join(
        gone, F.col(doc_id).eqNullSafe(F.col(gid)) & (F.col(key) == F.col(gkey)), "left_anti").drop(key)
