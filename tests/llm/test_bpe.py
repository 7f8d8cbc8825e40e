from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from paperloom.llm.arrays import steps
from paperloom.llm.bpe import Vocabulary, decode, encode, read_tokens

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    tokens = read_tokens(PATH)
    return Vocabulary(tokens), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_random_texts_as_tiktoken(known):
    vocabulary, reference = known
    rnd = random.Random(1)
    letters = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "a", "B", "é", "1", "½", "²", "!", "***",
               " ", " ", "　", "字", "😀", "\x00", "\x1c", "\x85", "ǅ", "ª", "xxxxx", "'S"]
    for _ in range(800):
        some = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(5)]
        for _, raw, at in steps(pa.array(some)):
            ids, counts = vocabulary.encode(raw, at)
            expected = [reference.encode_ordinary(t) for t in some]
            assert counts.tolist() == [len(e) for e in expected]
            assert ids.tolist() == sum(expected, [])
            assert vocabulary.decode(ids).tobytes() == "".join(some).encode()


def test_every_code_point_has_its_class(known):
    vocabulary, reference = known
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(every), 4000):
        text = "".join(f"a{c} 1" for c in every[i : i + 4000])
        for _, raw, at in steps(pa.array([text])):
            assert vocabulary.encode(raw, at)[0].tolist() == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20000, "!" * 9000, " " * 5000 + "x", "ab" * 9000 + " '" * 99])
def test_long_pieces(known, text):
    for _, raw, at in steps(pa.array([text])):
        assert known[0].encode(raw, at)[0].tolist() == known[1].encode_ordinary(text)


def test_round_trip_over_the_table(docs, empty, texts, known):
    coded = encode(docs, PATH, offsets=True)
    back = {}
    for r in decode(coded, PATH).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert r.n_tokens == len(ids)
        back.setdefault(r.doc_id, set()).add(bytes(r.decoded).decode())
        begins = np.frombuffer(r.offsets, "<u4").tolist()
        assert begins == sorted(begins) and len(begins) == len(ids)
        if len(ids):
            assert known[0].decode(ids[: len(ids) // 2].astype(np.int64)).tobytes() == bytes(r.decoded)[: begins[len(ids) // 2]]
    expected = {}
    for i, t in texts:
        expected.setdefault(i, set()).add(t or "")
    assert back == expected and coded.count() == len(texts)
    assert decode(encode(empty, PATH), PATH).collect() == []


def test_decoded_beside_the_ids(docs, texts):
    rows = encode(docs, PATH, offsets=True, decoded=True).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t in texts)
