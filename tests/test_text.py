"""Cleaning, sections, passages and metadata on hand-made documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import chunking as K
from paperloom.operators import cleaning as C
from paperloom.operators import metadata as M
from paperloom.operators import sections as S


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "dirty, clean",
    [
        ("a\x00b\x07c\x1fd", "abcd"),
        ("feder-\nated learning", "federated learning"),
        ("classiﬁer and efﬁcient", "classifier and efficient"),
        ("ca-\n  fé", "café"),
        ("soft­hyphen", "softhyphen"),
        ("a  \t b   \n\n\n\nc  ", "a b\n\nc"),
        ("one\r\ntwo\rthree four", "one\ntwothree\nfour"),
        ("  　 x  ", "x"),
    ],
)
def test_clean_text(spark, dirty, clean):
    got = one(spark, dirty, C.clean_text)
    assert got == clean.replace("twothree", "two\nthree")


def test_ligatures_without_python(spark):
    assert one(spark, "ﬁﬂﬀﬃﬄ", C.expand_ligatures) == "fiflffffiffl"


def test_running_lines(spark):
    pages = [("a", n, f"Journal of Tests\nbody {n}\n{n}") for n in range(4)]
    pages += [("b", n, ("Results\n" if n < 2 else f"Part {n}\n") + f"text {n}") for n in range(4)]
    pages += [("c", n, "Same head\nbody") for n in range(3)]
    df = spark.createDataFrame(pages, "doc_id string, page_no int, text string")
    got = {(r.doc_id, r.page_no): r.text for r in C.strip_running_lines(df).collect()}
    assert got[("a", 2)] == "body 2"
    assert got[("b", 0)] == "Results\ntext 0"
    assert got[("c", 0)] == "Same head\nbody"


def test_document_gates(spark):
    pages = [("ok", n, "word " * 30 + str(n)) for n in range(5)] + [("long", n, "x") for n in range(9)] + [("empty", 0, " ")]
    df = spark.createDataFrame(pages, "doc_id string, page_no int, text string")
    got = {r.doc_id: r for r in C.assemble_documents(df, max_pages=8).collect()}
    assert got["ok"].reject_code is None and got["ok"].text.startswith("word word")
    assert got["long"].reject_code == "PDF_TOO_COMPLEX" and got["long"].text is None
    assert got["empty"].reject_code == "NO_EXTRACTABLE_TEXT"


def detect(spark, text, **kw):
    df = spark.createDataFrame([("p", text)], "paper_id string, text string")
    return [(r.section_type, r.heading, r.content) for r in S.detect_sections(df, **kw).orderBy("order_index").collect()]


def test_headed_paper(spark):
    heads = ["Abstract", "1 Introduction", "2 Related Work", "3 Methodology", "4 Results", "5 Limitations", "6 Future Work", "References"]
    labels = [s[0] for s in detect(spark, "\n".join(f"{h}\nBody of {h}." for h in heads))]
    assert labels == ["abstract", "introduction", "related_work", "methodology", "results", "limitations", "future_work", "references"]


@pytest.mark.parametrize(
    "line, label",
    [
        ("Conclusions and Future Work", "future_work"),
        ("III. METHODOLOGY", "methodology"),
        ("Introduction to this topic is, sadly, a sentence.", None),
        ("A method we like", "methodology"),
        ("Limitations:", "limitations"),
        ("Background methods were slow;", None),
        ("Abstractions", None),
        ("Résultats", None),
    ],
)
def test_heading_label(spark, line, label):
    assert one(spark, line, S.heading_label) == label


def test_no_heading_and_merge(spark):
    prose = "Plain prose without any heading. " * 20
    assert [s[0] for s in detect(spark, prose)] == ["other"]
    merged = detect(spark, "3.1 Methodology\nfirst\n3.2 Methods\nsecond")
    assert merged == [("methodology", "3.1 Methodology", "first\n\n3.2 Methods\nsecond")]
    assert detect(spark, "Abstract\n\nReferences\n")[0][1] == "Document"


def test_abstract(spark):
    text = "Abstract: " + "We study things. " * 10
    assert one(spark, text, S.clean_abstract).startswith("We study things. We")
    assert one(spark, "Abstract short", S.clean_abstract) is None


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def chunks_of(spark, rows, **kw):
    df = spark.createDataFrame(
        [("p", n, kind, text) for n, (kind, text) in enumerate(rows)], "paper_id string, order_index int, section_type string, content string"
    )
    return K.chunk_sections(df, **kw).orderBy("chunk_index").collect()


def test_chunks_stay_in_sections(spark):
    got = chunks_of(spark, [("abstract", words("a", 400)), ("results", words("b", 400)), ("references", words("r", 900))], size=200, overlap=20)
    assert {c.section_type for c in got} == {"abstract", "results"}
    assert [c.chunk_index for c in got] == list(range(len(got)))
    assert all(c.token_count <= 200 for c in got)
    assert all(len({w[0] for w in c.content.split()}) == 1 for c in got)


def test_overlap_and_small_pieces(spark):
    sentences = " ".join(f"S{i} short words here." for i in range(60))
    got = chunks_of(spark, [("results", sentences)], size=80, overlap=25)
    for a, b in zip(got, got[1:]):
        assert set(a.content.split()) & set(b.content.split()) - {"short", "words", "here."}
    small = " ".join([f"X{words('w', 69)}." for _ in range(3)] + ["Tiny."])
    assert chunks_of(spark, [("results", small)], size=75, overlap=10)[-1].content.endswith("Tiny.")
    with pytest.raises(ValueError):
        chunks_of(spark, [("results", "x")], size=10, overlap=10)


def plain_model(sentences, size, overlap, least):
    """Straight model of the rules, over lists of words."""
    out, cur = [], []
    for s in sentences:
        n = len(s)
        if n > size:
            if cur:
                out.append(sum(cur, []))
                cur = []
            out += [s[i : i + size] for i in range(0, n, size)]
            continue
        if cur and sum(map(len, cur)) + n > size:
            out.append(sum(cur, []))
            keep = []
            for old in cur[::-1]:
                if sum(map(len, keep)) + len(old) > overlap:
                    break
                keep.insert(0, old)
            cur = keep
        cur.append(s)
    if cur:
        out.append(sum(cur, []))
    out = [c[i : i + size] for c in out for i in range(0, len(c), size)]
    done = []
    for c in out:
        if done and len(c) < least and len(done[-1]) + len(c) <= size:
            done[-1] = done[-1] + c
        else:
            done.append(c)
    if len(done) > 1 and len(done[0]) < least and len(done[0]) + len(done[1]) <= size:
        done[:2] = [done[0] + done[1]]
    return [" ".join(c) for c in done]


def test_passages_match_model():
    rng = random.Random(5)
    for trial in range(400):
        size, least = rng.randint(5, 60), rng.randint(0, 20)
        overlap = rng.randint(0, size - 1)
        sentences = [[f"t{trial}s{i}w{j}" for j in range(rng.choice([1, 3, 8, 20, 70]))] for i in range(rng.randint(1, 25))]
        expected = plain_model(sentences, size, overlap, least)
        parts = [" ".join(s) for s in sentences]
        assert K.split_passage(parts, K.count_words, size, overlap, least) == expected
        # A caller's tokenizer takes the general path.
        assert K.split_passage(parts, lambda t: len(t.split()), size, overlap, least) == expected


def test_chunk_plan():
    assert K.plan_chunks() == (256, 64)
    assert K.plan_chunks(512, 100, 64) == (100, 25)


def test_metadata(spark):
    page = "arXiv: 1706.03762 [cs]\nAttention for Everything in\nTwo Lines.\nAda Lovelace1, Bo Peep* and Cy Young\nAbstract\n10.1145/3292500.3330701. Published 2019, cites 1999 and 2049"
    df = spark.createDataFrame([("p", page)], "paper_id string, first_page string")
    r = M.first_page_metadata(df, 2026).first()
    assert r.title == "Attention for Everything in Two Lines"
    assert r.authors == ["Ada Lovelace", "Bo Peep", "Cy Young"]
    assert (r.doi, r.arxiv_id, r.publication_year) == ("10.1145/3292500.3330701", "1706.03762", 2019)
    assert one(spark, "only 2049", lambda c: M.publication_year(c, 2026)) is None
    assert one(spark, "Microsoft Word - draft7.docx", M.plausible_title) is False


def test_blocks(spark):
    blocks = spark.createDataFrame(
        [("p", "Permission to reproduce is granted", 19.0, 40.0), ("p", "A Real Title Here", 17.0, 120.0), ("p", "Ada Lovelace, Bo Peep", 11.0, 160.0)],
        "paper_id string, text string, font_size double, top double",
    )
    titles = M.title_from_blocks(blocks)
    assert titles.first()["title"] == "A Real Title Here"
    assert M.authors_from_blocks(blocks, titles).first()["authors"] == ["Ada Lovelace", "Bo Peep"]


@pytest.mark.parametrize("query, person", [
    ("Yoshua Bengio", True), ("Geoffrey E. Hinton", True), ("Jean-Baptiste Alayrac", True), ("Deep Learning", False),
    ("BERT 2019", False), ("transformers", False), ("one two", False), ("A B C D E", False),
])
def test_person_names(spark, query, person):
    assert one(spark, query, M.is_person_name) is person


def test_keyword_search_by_stems_and_project(spark):
    from paperloom.operators.keyword import keyword_search, stem

    words = ["networks", "network", "running", "run", "studies", "study", "boxes", "learning", "learn", "bus", "Übungen"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(stem(F.col("w"))).collect()]
    assert got == ["network", "network", "run", "run", "study", "study", "box", "learn", "learn", "bus", "Übungen"]
    chunks = spark.createDataFrame([(1, 1, "neural networks learning", "p"), (2, 1, "a network learns", "q"), (3, 2, "network learn", "p")],
                                   "chunk_id int, user_id int, content string, project_id string")
    asks = spark.createDataFrame([(10, 1, "network learn", None), (11, 1, "networks learned", "q")],
                                 "query_id int, user_id int, text string, want_project string")
    found = sorted((r.query_id, r.chunk_id) for r in keyword_search(chunks, asks).collect())
    assert found == [(10, 1), (10, 2), (11, 2)]


def test_few_sections_are_python_objects_at_a_time(spark, monkeypatch):
    """However many sections an Arrow batch has, they are cut a few at a time, in order."""
    rows = [(n, 0, "other", " ".join(f"S{n} word {i}." for i in range(n))) for n in range(1, 12)]
    df = spark.createDataFrame(rows, "paper_id int, order_index int, section_type string, content string").coalesce(1)
    monkeypatch.setattr(K, "FOLD_ROWS", 3)
    seen = {(r.paper_id, r.chunk_index): r.content for r in K.chunk_sections(df, size=10, overlap=0, least=0).collect()}
    assert seen == {(n, at): " ".join(f"S{n} word {i}." for i in range(3 * at, min(3 * at + 3, n)))
                    for n in range(1, 12) for at in range((n + 2) // 3)}
