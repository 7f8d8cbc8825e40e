"""Queries against their SQL on tables that the smallest ones do not have the like of."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from oracle import compare
from paperloom.queries import load
from paperloom.queries.analytics import inverted_index

SMALL = contract.SMOKE_FOLDER
SPARK, DUCK = load()


def tables(folder, **changed: str):
    """The smallest tables under ``folder`` with some of them replaced by SQL over them, each of these as three parts; DuckDB over the same."""
    folder, con = str(folder), duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        if name not in changed:
            os.symlink(path, f"{folder}/{name}.parquet")
            con.execute(f"CREATE VIEW {name} AS FROM read_parquet('{path}')")
            continue
        rows = f"({changed[name].format(path)})"
        os.mkdir(f"{folder}/{name}.parquet")
        for n in range(3):
            con.execute(f"COPY (SELECT * EXCLUDE (part) FROM (SELECT *, row_number() OVER () % 3 AS part FROM {rows}) WHERE part = {n}) TO '{folder}/{name}.parquet/part-{n}.parquet'")
        con.execute(f"CREATE VIEW {name} AS FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ["l1_incremental_index", "m3_percolation", "m3_saved_search_alerts", "l4_job_state", "l6_activity_counts"])
def test_streams_read_tables_of_several_parts(spark, tmp_path, name):
    folder, con = tables(tmp_path, documents="FROM '{}'", embeddings="FROM '{}'", events="FROM '{}'")
    assert compare(spark, con, folder, SPARK[name], DUCK[name])[2] == "ok"


def test_bibliography_with_many_equal_keys(spark, tmp_path):
    """One project holds 120,000 papers, so that some keys repeat more than 160 times."""
    folder, con = tables(tmp_path, documents="SELECT i AS doc_id, 'T' || i AS text, 'en' AS lang, 'src0' AS source, 2::BIGINT AS n_chars FROM range(120000) t(i) WHERE '{}' <> ''",
                         events="SELECT * FROM '{}' WHERE event_id < 60")
    for name in ("j1_bibtex", "j2_citation_keys"):
        assert compare(spark, con, folder, SPARK[name], DUCK[name])[2] == "ok"


ODD_TEXTS = """
    SELECT * EXCLUDE (n), length(text)::BIGINT AS n_chars FROM (
      SELECT n, n // 2 * 2 AS doc_id, 'en' AS lang, 'src1' AS source, CASE n % 14
        WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '...' WHEN 3 THEN ' ' || chr(10) WHEN 4 THEN chr(9) || 'a b' || chr(9)
        WHEN 5 THEN words || chr(10) || chr(10) || words WHEN 6 THEN words || chr(10) || '.' || chr(10) || 'end' WHEN 7 THEN chr(9) || words || chr(13)
        WHEN 8 THEN replace(words, ' ', chr(160)) || ' x' WHEN 9 THEN chr(160) || words || ' ' || words || chr(8232) WHEN 10 THEN replace(words, ' ', chr(11)) || words
        WHEN 11 THEN replace(words, ' ', '  ' || chr(10)) WHEN 12 THEN words || ' ! ' || words || chr(28) || 'x' ELSE 'a' || chr(9) || chr(9) || 'b  c' || chr(133) END AS text
      FROM (SELECT i AS n, array_to_string(list_transform(range(19 + i // 14), lambda j: 'w' || j), ' ') AS words FROM range(56) t(i) WHERE '{}' <> ''))"""


def test_word_split_of_odd_texts(spark, tmp_path):
    """Empty texts, empty lines, blanks beyond ASCII, 19 to 22 words, two texts for an id."""
    folder, con = tables(tmp_path, documents=ODD_TEXTS)
    name = "c4_word_split"
    assert compare(spark, con, folder, SPARK[name], DUCK[name])[2] == "ok"


def shuffled_records(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))


@pytest.mark.parametrize("name", ["j1_bibtex", "j2_citation_keys"])
def test_papers_of_a_project_are_not_shuffled_for_each_export(spark, tmp_path, name):
    """Hundreds of exports list one project of a user, some exports come twice."""
    folder, con = tables(tmp_path, documents="SELECT i AS doc_id, 'T' || i AS text, 'en' AS lang, 'src0' AS source, 2::BIGINT AS n_chars FROM range(4000) t(i) WHERE '{}' <> ''",
                         events="SELECT * REPLACE (event_id * 20 AS event_id) FROM (FROM '{0}' UNION ALL FROM '{0}' WHERE event_id % 50 = 2)")
    before = shuffled_records(spark)
    rows, _, verdict = compare(spark, con, folder, SPARK[name], DUCK[name])
    assert verdict == "ok" and rows > 100_000
    assert shuffled_records(spark) - before < rows / 2


def test_lifetime_at_the_ends_of_days(spark, tmp_path):
    """Uploads in the last half second of a day, and around a leap day, which a calendar year would shift."""
    folder, con = tables(tmp_path, events="""
        SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-01 23:59:59.7' + INTERVAL (event_id % 9) DAY
                               ELSE TIMESTAMP '2024-02-27 12:00:00' + INTERVAL (event_id * 7 % 96) HOUR END AS ts, event_id % 5 AS user_id) FROM '{}'""")
    name = "l5_lifetime_suppression"
    assert compare(spark, con, folder, SPARK[name], DUCK[name])[2] == "ok"


def test_comparison_of_a_single_paper(spark, tmp_path):
    """The last request has one paper, its reply two values."""
    folder, con = tables(tmp_path, documents="SELECT * FROM '{}' WHERE doc_id < 197")
    name = "plan_comparison"
    assert compare(spark, con, folder, SPARK[name], DUCK[name])[2] == "ok"


def test_words_are_not_dealt_out_again(spark):
    """Words go to their documents' index where the text is: only whole texts are moved."""
    plan = inverted_index(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
