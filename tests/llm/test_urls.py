from __future__ import annotations

import pytest

from paperloom.llm.queries import HOST_RULES
from paperloom.llm.urls import build_index, judge_urls, rule_tokens

URLS = [
    None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://a.com/", "http://a.com?x=/",
    "https://Example.COM/en/1", "https://example.com/en", "https://www.example.com/en/x", "https://a.www.example.com/en/",
    "https://wwwexample.com/en/x", "http://b.example.net/es/1", "http://b.example.net/ES/1", "http://x.net/fr/#a",
    "http://adult-x.example.org/", "http://adult.example.com/", "http://a.spam-farm.org/x", "http://spammer.org/",
    "https://a.com/en/?u=http://b.net/es/", "http://com.net/es/", "http://münchen.net/es/ü", "http://a.com/" + "p/" * 5000,
    "http://a.com/", "http://a.com/\n://x.net/es/",
]


def brute(url, rules=HOST_RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(r), r, a) for r, a in rules
            if ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    import re

    bad = re.search(r"(?<![a-z0-9])(adult|spam|casino|malware)(?![a-z0-9])", host)
    return host, path, None, "block" if bad else "allow"


def judged(spark, urls, **options):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    return {r.page_id: r for r in judge_urls(df, HOST_RULES, **options).collect()}


def test_every_case_against_brute_force(spark):
    got = judged(spark, URLS)
    for i, url in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == brute(url), url


def test_repeated_rows_and_empty_table(spark):
    assert len(judged(spark, URLS + URLS)) == 2 * len(URLS)
    none = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(none, HOST_RULES).collect() == []
    assert judge_urls(none, []).columns == ["page_id", "url", "host", "path", "rule", "verdict", "pattern"]


def test_rules_stand_under_their_rarest_whole_token():
    assert rule_tokens("example.com/en/x") == ["example", "com", "en"]
    placed = build_index([("example.com/en/", "block")], [], {"example": 5, "com": 9, "en": 2})
    assert placed[0]["token"] == "en"


def test_no_shuffle(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = judge_urls(df, HOST_RULES, counts={})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_too_large_an_index_is_refused(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    with pytest.raises(ValueError, match="index"):
        judge_urls(df, [(f"{'h' * 2000}{i}.com/", "block") for i in range(3000)], counts={})
