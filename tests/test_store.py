"""Uploads, stored rows, keys, plans and owner isolation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import bookkeeping as B
from paperloom.operators import export as X
from paperloom.operators import retrieval as R
from paperloom.sources import sinks, uploads
from paperloom.sources.versions import read_versions
from paperloom.streaming.jobs import index_stream, stream_files


@pytest.mark.parametrize("body, code", [
    (b"%PDF-1.7 x", None), (b" " * 500 + b"%PDF-1.4", None), (b"x" * 2000 + b"%PDF-1.4", "UNSUPPORTED_FILE_TYPE"), (b"plain", "UNSUPPORTED_FILE_TYPE"),
    (b"PK\x03\x04", "UNSUPPORTED_FILE_TYPE"), (b"", "EMPTY_FILE"), (b"%PD", "UNSUPPORTED_FILE_TYPE"), (b"%PDF-" + b"y" * 5000, "FILE_TOO_LARGE"), (None, "EMPTY_FILE"),
])
def test_upload(spark, body, code):
    df = spark.createDataFrame([(bytearray(body) if body is not None else None,)], "content binary")
    assert uploads.validate_uploads(df, 4000).first()["reject_code"] == code


def test_file_scan(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"\x80%PDF-1.7")
    (tmp_path / "b.pdf").write_bytes(b"no")
    (tmp_path / "c.txt").write_bytes(b"%PDF-")
    got = uploads.validate_uploads(uploads.scan_files(spark, str(tmp_path))).select("path", "reject_code").collect()
    assert {r.path[-5:]: r.reject_code for r in got} == {"a.pdf": None, "b.pdf": "UNSUPPORTED_FILE_TYPE"}


@pytest.mark.parametrize("name, title", [
    ("attention_is_all_you_need.pdf", "attention is all you need"), ("1706.03762.pdf", "1706.03762"), ("../../etc/passwd.pdf", "passwd"),
    ("C:\\Users\\x\\paper.pdf", "paper"), (None, "Untitled paper"), ("   ", "Untitled paper"), (".pdf", "Untitled paper"), ("a" * 400, "a" * 300),
])
def test_titles(spark, name, title):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(uploads.title_from_filename(F.col("n")).alias("t")).first()["t"] == title


def test_cache_key(spark):
    rows = [("qa", "m", "What  is X", ["b", "a"]), ("qa", "m", " what is x ", ["a", "b"]), ("qa", "m", "what is y", ["a", "b"]),
            ("qa", "n", "what is x", ["a", "b"]), ("gap", "m", "what is x", ["a", "b"]), ("qa", "m", "what is x", ["a", "b", "ext:1"]), ("qa", None, None, [])]
    df = spark.createDataFrame(rows, "t string, m string, q string, e array<string>")
    keys = [r.k for r in df.select(B.cache_key(*[F.col(c) for c in "tmqe"]).alias("k")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 6 and all(len(k) == 64 for k in keys)
    import hashlib
    assert keys[0] == hashlib.sha256(b"qa|m|what is x|,a,b").hexdigest()
    assert keys[6] == hashlib.sha256(b"qa|||").hexdigest()


def test_reindex_matches_loop(spark):
    rng = random.Random(6)
    papers = [(n, rng.choice([1, 1, 2]), rng.choice([0, 0, 1]), rng.choice(["completed", "completed", "failed"]), rng.choice(["k", "k", None]), rng.randrange(60)) for n in range(300)]
    jobs = [(n, rng.choice(["queued", "running", "completed"])) for n in range(300) if rng.random() < 0.5]
    p = spark.createDataFrame(papers, "paper_id int, user_id int, index_version int, processing_status string, object_key string, created_at int")
    j = spark.createDataFrame(jobs, "paper_id int, status string")
    active = {n for n, s in jobs if s != "completed"}
    for limit in (1, 7, 150):
        queue, report = B.reindex_plan(p, j, limit)
        got, rep = {}, {r.user_id: r for r in report.collect()}
        for r in queue.collect():
            got.setdefault(r.user_id, set()).add(r.paper_id)
        for user in (1, 2):
            rows = sorted((c, n) for n, u, v, s, k, c in papers if u == user and v < 1 and s == "completed" and k)
            queued, busy = [], 0
            for _, n in rows:
                if len(queued) >= limit:
                    break
                if n in active:
                    busy += 1
                else:
                    queued.append(n)
            assert got[user] == set(queued)
            assert (rep[user].outdated, rep[user].queued, rep[user].busy, rep[user].remaining) == (len(rows), len(queued), busy, len(rows) - len(queued))


def test_citation_suffixes(spark):
    papers = spark.createDataFrame([(n, ["Ada L."], 2020, f"T{n} {{x}} \\", None, None) for n in range(3)],
                                   "paper_id int, authors array<string>, publication_year int, title string, venue string, doi string")
    cited = spark.createDataFrame([(1, n, n) for n in range(3)], "analysis_id int, paper_id int, position int")
    keys = [r.citation_key for r in X.bibliography(cited, papers).orderBy("position").collect()]
    assert keys == ["adal2020", "adal2020a", "adal2020b"]
    esc = papers.select(X.bib_escape(F.col("title")).alias("a"), X.bib_escape(F.col("title"), True).alias("b")).first()
    assert esc.a == "T0 \\{x\\} \\\\" and esc.b == "T0 \\\\{x\\\\} \\\\"


def test_citation_suffixes_of_many_papers(spark):
    papers = spark.range(300).selectExpr("id AS paper_id", "array('Ada L.') AS authors", "2020 AS publication_year", "'T' AS title",
                                         "cast(NULL AS string) AS venue", "cast(NULL AS string) AS doi")
    cited = spark.range(300).selectExpr("1 AS analysis_id", "id AS paper_id", "id AS position")
    keys = [r.citation_key for r in X.bibliography(cited, papers).orderBy("position").collect()]
    assert keys == ["adal2020"] + ["adal2020" + chr(96 + n) for n in range(1, 300)]


def test_replace_in_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda ids, tag: spark.createDataFrame([(i, n, f"{tag}{i}") for i in ids for n in range(2)], "paper_id int, chunk_index int, content string")
    sinks.write_bucketed(rows(range(20), "old"), path, buckets=4)
    new = rows([3, 40], "new").filter("chunk_index = 0")
    for _ in range(2):  # a repeated run changes nothing more
        sinks.replace_in_table(spark, new, path)  # by the table's own number of buckets
    got = {(r.paper_id, r.chunk_index): r.content for r in spark.read.parquet(path).collect()}
    assert got[(3, 0)] == "new3" and (3, 1) not in got and got[(40, 0)] == "new40" and got[(7, 1)] == "old7" and len(got) == 40
    sinks.replace_in_table(spark, new.limit(0), path, replaced=spark.createDataFrame([(n,) for n in range(41)], "paper_id int"))
    assert spark.read.parquet(path).count() == 0


def test_index_stream_replaces(spark, tmp_path):
    schema = "paper_id bigint, text string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: index_stream(stream_files(spark, str(tmp_path / "in"), "*.parquet", schema), str(tmp_path / "out"), str(tmp_path / "ck"), buckets=4).awaitTermination()
    put([(1, "Abstract\nfirst words\nResults\nold result"), (2, "Plain text only")])
    run()
    put([(1, "Abstract\nsecond words")])
    run()
    run()
    got = {(r.paper_id, r.section_type): r.content for r in read_versions(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, "abstract"): "second words", (2, "other"): "Plain text only"}


def test_newest_version_wins_in_one_batch(spark, tmp_path):
    schema = "paper_id bigint, text string, at int"
    rows = [(1, "Abstract\nzz old", 1), (1, "Abstract\nnew words", 2), (2, "Only", 5), (1, "Abstract\nyy older", 0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    index_stream(stream_files(spark, str(tmp_path / "in"), "*.parquet", schema), str(tmp_path / "out"), str(tmp_path / "ck"),
                 buckets=2, arrival="at").awaitTermination()
    got = {(r.paper_id, r.content) for r in read_versions(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, "new words"), (2, "Only")}


def test_foreign_and_orphan_passages_take_no_place(spark):
    chunks = spark.createDataFrame([(1, 10, 1, [1.0, 0.0]), (2, 99, 1, [1.0, 0.1]), (3, 20, 1, [1.0, 0.2]), (4, 10, 1, [0.0, 1.0])],
                                   "chunk_id int, paper_id int, user_id int, embedding array<float>")
    papers = spark.createDataFrame([(10, 1, "A", 2000), (20, 2, "B", 2001)], "paper_id int, user_id int, title string, publication_year int")
    ask = spark.createDataFrame([(7, 1, [1.0, 0.3], 2), (8, 1, None, 2)], "query_id int, user_id int, embedding array<float>, top_k int")
    got = R.search(chunks, papers, ask).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(7, 1), (7, 4)]


def test_owner_isolation(spark):
    """Taking away another user's rows never changes a result; an intruder gets nothing."""
    chunks = spark.createDataFrame([(n, n % 6, n % 2, "results", f"text {n}", [float(n % 5), 1.0]) for n in range(24)],
                                   "chunk_id int, paper_id int, chunk_index int, section_type string, content string, embedding array<float>")
    papers = spark.createDataFrame([(n, 1 if n < 3 else 2, "pr", f"T{n}", 2000, ["x"]) for n in range(6)],
                                   "paper_id int, user_id int, project_id string, title string, publication_year int, tags array<string>")
    qs = spark.createDataFrame([(1, 1, [1.0, 1.0], 4), (2, 3, [1.0, 1.0], 4)], "query_id int, user_id int, embedding array<float>, top_k int")
    with_user = lambda p: chunks.join(p.select("paper_id", "user_id"), "paper_id")
    both = {tuple(r) for r in R.search(with_user(papers), papers, qs).select("query_id", "chunk_id", "rank").collect()}
    mine = papers.filter("user_id = 1")
    assert both == {tuple(r) for r in R.search(with_user(mine), mine, qs).select("query_id", "chunk_id", "rank").collect()}
    assert len(both) == 4 and {q for q, _, _ in both} == {1}
    ask = spark.createDataFrame([(1, 3, list(range(24)))], "request_id int, user_id int, chunk_ids array<int>")
    assert R.reload_chunks(ask, with_user(papers), papers).count() == 0


def test_text_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "# A\n\nb")], "analysis_id int, document string")
    sinks.write_text(df, str(tmp_path / "md"))
    sinks.write_json(df, str(tmp_path / "js"))
    assert [r.value for r in spark.read.text(str(tmp_path / "md"), wholetext=True).collect()] == ["# A\n\nb\n"]
    assert spark.read.json(str(tmp_path / "js")).first()["analysis_id"] == 1
