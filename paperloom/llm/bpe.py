"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation (operator 3)."""

from __future__ import annotations

import base64
import functools
import heapq
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import STEP_BYTES, hash_runs, spread, steps

SPACE, BLANK, LETTER, NUMBER, OTHER, START = range(6)
#: Unicode's White_Space property, the contractions of the pattern.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Pieces longer than this are merged one by one with a heap, shorter ones together as arrays.
LONG_PIECE = 128
#: Distinct pieces whose merges a worker remembers.
CACHE_PIECES = 1 << 18
#: Rows that are decoded together.
DECODE_ROWS = 512
#: Largest vocabulary file that is broadcast.
VOCABULARY_BYTES = 64 << 20

_NEVER = np.int64(1) << 40


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for found in regex.finditer(pattern, every):
            run = found.group()
            table[ord(run[0]) : ord(run[-1]) + 1] = value
    table[list(WHITE_SPACE)] = BLANK
    table[0x20] = SPACE
    return table


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte where each begins."""
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[begins].astype(np.int32)
    if not (lead >= 0x80).any():
        return lead, begins
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    points = np.where(size == 1, lead, lead & (0x7F >> size))
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        points[more] = (points[more] << 6) | (raw[begins[more] + k] & 0x3F)
    return points, begins


def since_reset(reset: np.ndarray) -> np.ndarray:
    """Characters since the last reset, by a scan over transition functions.

    Each character's transition is either "become 0" or "add 1". Such functions
    compose associatively: the last reset at or before a character decides, so a
    running maximum over the reset positions is the whole scan.
    """
    here = np.arange(len(reset))
    return here - np.maximum.accumulate(np.where(reset, here, -1))


def piece_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets where the matches of the GPT-2 style pattern begin, over texts cut at ``at``.

    The pattern's alternatives only look at the class of a character, at its
    neighbours, and at how far a run of white space or a contraction has come,
    so boundaries follow from class arrays and two scans.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    points, begins = code_points(raw)
    kind = classes()[points]
    n = len(kind)
    opens = np.zeros(n, bool)
    opens[np.searchsorted(begins, at[:-1][at[:-1] < at[1:]])] = True
    closes = np.append(opens[1:], True)
    before = np.empty(n, np.uint8)
    before[0] = START
    before[1:] = kind[:-1]
    before[opens] = START
    after = np.full(n, START, np.uint8)
    after[:-1] = kind[1:]
    after[closes] = START
    white, white_after = kind <= BLANK, after <= BLANK

    # White space: a run is one piece, but its last character stands alone before a word,
    # and joins the word when it is a plain space.
    run = since_reset(~white | opens & white) + (opens & white)
    first_white = white & ((before > BLANK) | opens)
    last_white = white & ~white_after & (after != START) & ~first_white & (run >= 1)
    starts = first_white | last_white
    joins = (before == SPACE) & ~white
    starts |= ~white & ~joins & (before != kind)

    # Contractions: an apostrophe that begins a piece takes one or two letters with it.
    quote = (points == 0x27) & ((before == LETTER) | (before == NUMBER) | (before == START) | (before == BLANK))
    if quote.any():
        marks = np.flatnonzero(quote)
        following = np.stack([
            np.where((marks + k < n) & ~closes[np.minimum(marks + k - 1, n - 1)], points[np.minimum(marks + k, n - 1)], 0)
            for k in (1, 2)
        ])
        following[1][following[0] == 0] = 0
        length = np.zeros(len(marks), np.int64)
        for word in CONTRACTIONS:
            fits = length == 0
            for k, letter in enumerate(word):
                fits &= following[k] == ord(letter)
            length[fits] = len(word)
        inside = marks[length > 0]
        length = length[length > 0]
        starts[spread(length, inside + 1)] = False
        beyond = inside + length + 1
        beyond = beyond[beyond < n]
        starts[beyond[kind[beyond] == LETTER]] = True
    starts |= opens
    return begins[starts]


class Vocabulary:
    """Tokens by rank, and the rank of every pair of tokens that is a token itself."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        rank = {t: i for i, t in enumerate(tokens)}
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, r in rank.items():
            for i in range(1, len(token)):
                left, right = rank.get(token[:i]), rank.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = r
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pairs = np.append(keys[order], np.int64(2**62))
        self.ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], _NEVER)
        self.pair_rank = pairs
        self.seen = np.zeros(0, np.uint64)
        self.seen_first = np.zeros(0, np.int64)
        self.seen_length = np.zeros(0, np.int64)
        self.seen_ids = np.zeros(0, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        found = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[found] == keys, self.ranks[found], _NEVER)

    def merge_long(self, symbols: list[int]) -> list[int]:
        """One piece of any length: a heap of pairs over a linked list."""
        n = len(symbols)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols = list(symbols)
        heap = []

        def push(i):
            if 0 <= i and following[i] < n:
                r = self.pair_rank.get(symbols[i] << 32 | symbols[following[i]])
                if r is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[following[i]]))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            if symbols[i] != left or following[i] >= n or symbols[following[i]] != right:
                continue
            gone = following[i]
            symbols[i], symbols[gone] = r, -1
            following[i] = following[gone]
            if following[i] < n:
                previous[following[i]] = i
            push(previous[i])
            push(i)
        out, i = [], 0
        while i < n:
            out.append(symbols[i])
            i = following[i]
        return out

    def merge(self, raw: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of each piece, one after the other, and how many each has.

        All pieces take their lowest-ranked leftmost merge at the same time, until
        none has a merge left.
        """
        counts = np.ones(len(first), np.int64)
        symbols = self.single[raw[spread(lengths, first)]]
        owner = np.repeat(np.arange(len(first)), lengths)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        long = lengths > LONG_PIECE
        if long.any():
            for piece in np.flatnonzero(long):
                own = self.merge_long(symbols[owner == piece].tolist())
                parts.append((np.full(len(own), piece), np.array(own, np.int64)))
            stay = ~long[owner]
            symbols, owner = symbols[stay], owner[stay]
        ranks = self._pair_ranks(symbols, owner)
        while len(symbols):
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(ranks, begin)
            sizes = np.diff(np.append(begin, len(symbols)))
            done = np.repeat(least == _NEVER, sizes)
            if done.any():
                parts.append((owner[done], symbols[done]))
                keep = ~done
                symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
                if not len(symbols):
                    break
                going = least != _NEVER
                least, sizes = least[going], sizes[going]
            hit = np.flatnonzero(ranks == np.repeat(least, sizes))
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]
            symbols[hit] = ranks[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = hit - np.arange(len(hit))
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            self._refresh(symbols, owner, ranks, place)
            left = place - 1
            self._refresh(symbols, owner, ranks, left[(left >= 0)])
        if not parts:
            return np.zeros(0, np.int64), counts
        owners = np.concatenate([p[0] for p in parts])
        ids = np.concatenate([p[1] for p in parts])
        order = np.argsort(owners, kind="stable")
        return ids[order], np.bincount(owners, minlength=len(first))

    def _pair_ranks(self, symbols, owner):
        out = np.full(len(symbols), _NEVER, np.int64)
        if len(symbols) > 1:
            same = np.flatnonzero(owner[1:] == owner[:-1])
            out[same] = self.rank(symbols[same], symbols[same + 1])
        return out

    def _refresh(self, symbols, owner, ranks, place):
        inner = (place + 1 < len(symbols))
        paired = place[inner][owner[place[inner]] == owner[place[inner] + 1]]
        ranks[place] = _NEVER
        ranks[paired] = self.rank(symbols[paired], symbols[paired + 1])

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts cut at ``at``, and the number of tokens of each text."""
        starts = piece_starts(raw, at)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
        ends = np.append(starts[1:], len(raw))
        keys, where, back = np.unique(hash_runs(raw, starts, ends), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.seen, keys), max(0, len(self.seen) - 1))
        known = self.seen[place] == keys if len(self.seen) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        ids, counts = self.merge(raw, starts[where[new]], (ends - starts)[where[new]])
        pool = np.concatenate([self.seen_ids, ids])
        first, length = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        first[known], length[known] = self.seen_first[place[known]], self.seen_length[place[known]]
        first[new], length[new] = len(self.seen_ids) + np.cumsum(counts) - counts, counts
        if len(new) and len(self.seen) < CACHE_PIECES:
            merged = np.concatenate([self.seen, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.seen = merged[order]
            self.seen_first = np.concatenate([self.seen_first, first[new]])[order]
            self.seen_length = np.concatenate([self.seen_length, length[new]])[order]
            self.seen_ids = pool
        per_piece = length[back]
        tokens = pool[spread(per_piece, first[back])]
        before = np.append(0, np.cumsum(per_piece))
        return tokens, np.diff(before[np.searchsorted(starts, at)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[spread(self.lengths[ids], self.first[ids])]


def read_tokens(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token and rank a line), in order of rank."""
    with open(path, "rb") as lines:
        ranked = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in lines if line.strip())]
    if sum(len(t) for t, _ in ranked) > VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has more than {VOCABULARY_BYTES} bytes")
    tokens = [t for t, _ in sorted(ranked, key=lambda x: x[1])]
    if [r for _, r in sorted(ranked, key=lambda x: x[1])] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return tokens


_built: dict = {}


def _vocabulary(key, shared) -> Vocabulary:
    if key not in _built:
        _built.clear()
        _built[key] = Vocabulary(shared.value)
    return _built[key]


def _share(df: DataFrame, path: str):
    return path + uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(read_tokens(path))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", offsets: bool = False,
           decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids[, offsets][, decoded]), one row per row of ``docs``.

    ``path`` names a rank file on the driver; its tokens are broadcast after a
    check of their size. ``ids`` holds the ids as little-endian unsigned 32-bit
    integers, ``offsets`` the byte of the text where each token begins, so that
    any range of tokens can be traced to its text; ``decoded`` holds the bytes that
    the ids stand for, as ``decode`` would give them from a task of its own. Each match of the pattern is
    encoded on its own, without special tokens, as tiktoken does.

    Rows are encoded where they lie; texts are worked on in runs of about 1 MB,
    and one longer text is a run of its own. A null or empty text has no tokens.
    Repeated rows are encoded alike, an empty table gives no rows, other columns
    are not read.
    """
    key, shared = _share(docs, path)

    def work(batches):
        vocabulary = _vocabulary(key, shared)
        for batch in batches:
            for row, raw, at in steps(batch.column(1), STEP_BYTES):
                ids, counts = vocabulary.encode(raw, at)
                ends = np.cumsum(counts)
                small = ids.astype("<u4")
                columns = [batch.column(0).slice(row, len(counts)), pa.array(counts, pa.int64()),
                           pa.array([small[e - k : e].tobytes() for e, k in zip(ends, counts)], pa.binary())]
                names = ["doc_id", "n_tokens", "ids"]
                if offsets:
                    begin = np.cumsum(vocabulary.lengths[ids]) - vocabulary.lengths[ids]
                    columns.append(pa.array([(begin[e - k : e] - a).astype("<u4").tobytes()
                                             for e, k, a in zip(ends, counts, at)], pa.binary()))
                    names.append("offsets")
                if decoded:
                    columns.append(pa.array([vocabulary.decode(ids[e - k : e].astype(np.int64)).tobytes()
                                             for e, k in zip(ends, counts)], pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(picked.dtypes)['doc_id']}, n_tokens long, ids binary"
    return picked.mapInArrow(work, schema + (", offsets binary" if offsets else "") + (", decoded binary" if decoded else ""))


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes its ids stand for in ``into``; null ids give no bytes."""
    key, shared = _share(encoded, path)
    rest = [c for c in encoded.columns if c != into]

    def work(batches):
        vocabulary = _vocabulary(key, shared)
        for batch in batches:
            for row in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(row, DECODE_ROWS)
                cells = [vocabulary.decode(np.frombuffer(x.as_py() or b"", "<u4").astype(np.int64)).tobytes()
                         for x in part.column(rest.index(ids))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.binary())], [*rest, into])

    schema = encoded.select(*rest).schema.add(into, "binary")
    return encoded.select(*rest).mapInArrow(work, schema)
