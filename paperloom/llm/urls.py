"""URL filter: pattern rules indexed by their rarest literal token (operator 1, DataFrame functions only)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, UPPER, unused

#: Largest index, in bytes of JSON, that is placed into the plan as a literal.
INDEX_BYTES = 8 << 20

#: (name, action, pattern searched in host + path, a literal token that every match contains).
#: They give the verdict of addresses that no host rule fits.
PATTERNS = (
    ("adult hosts", "block", r"^[^/]*(?<![a-z0-9])adult(?![a-z0-9])", ("adult",)),
    ("spam hosts", "block", r"^[^/]*(?<![a-z0-9])spam(?![a-z0-9])", ("spam",)),
    ("casino hosts", "block", r"^[^/]*(?<![a-z0-9])casino(?![a-z0-9])", ("casino",)),
    ("malware hosts", "block", r"^[^/]*(?<![a-z0-9])malware(?![a-z0-9])", ("malware",)),
)

_RULE = T.StructType([T.StructField(n, T.StringType()) for n in ("token", "rule", "action", "regex")]
                     + [T.StructField("weight", T.IntegerType())])


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_tokens(rule: str) -> list[str]:
    """Runs of letters and digits that every fitting address contains as whole runs.

    The last run of a rule that ends inside a word is left out: the address may
    go on with the same word there.
    """
    host, slash, path = rule.partition("/")
    found = re.findall(r"[a-z0-9]+", host.lower())
    runs = re.findall(r"[A-Za-z0-9]+", path)
    if runs and re.search(r"[A-Za-z0-9]$", path):
        runs.pop()
    if not slash:
        return found
    return found + runs


def rule_regex(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return r"^(?:[^/]*\.)?" + _quoted(host.lower()) + _quoted(slash + path)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text) if text else ""


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(
        F.regexp_extract_all(host, F.lit("[a-z0-9]+"), F.lit(0)),
        F.regexp_extract_all(path, F.lit("[A-Za-z0-9]+"), F.lit(0)),
    ))


def token_counts(pages: DataFrame, tokens: set[str], url: str = "url") -> dict[str, int]:
    """In how many addresses each of the rules' tokens occurs; one partial aggregation, a row a token."""
    rows = (
        pages.select(F.explode(url_tokens(host_of(F.col(url)), path_of(F.col(url)))).alias("token"))
        .filter(F.col("token").isin(sorted(tokens)))
        .groupBy("token").count().collect()
    )
    return {r["token"]: r["count"] for r in rows}


def build_index(rules, patterns, counts: dict[str, int]) -> list[dict]:
    """Each rule under the rarest of its tokens."""
    entries = []
    for text, action in rules:
        entries.append((rule_tokens(text), text, action, rule_regex(text), 1 + len(text)))
    for name, action, regex, tokens in patterns:
        entries.append((list(tokens), name, action, regex, 0))
    placed = []
    for tokens, name, action, regex, weight in entries:
        if not tokens:
            raise ValueError(f"rule {name!r} has no literal token to index it by")
        token = min(tokens, key=lambda t: (counts.get(t, 0), t))
        placed.append({"token": token, "rule": name, "action": action, "regex": regex, "weight": weight})
    return placed


def judge_urls(pages: DataFrame, rules, patterns=PATTERNS, default: str = "allow", url: str = "url",
               counts: dict[str, int] | None = None) -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``pattern``.

    ``rules`` is a list of (host and path, action). A rule fits its host and all
    subdomains when the path starts with the rule's; the longest fitting rule
    decides (of equally long ones the first in order of text). Without one,
    ``rule`` is null and the first fitting pattern decides, else ``default``.

    Each rule stands in the index under its rarest token, by the counts over the
    given addresses. An address looks up its own tokens, and only the rules found
    there run their regular expressions. All of it is one projection: no shuffle,
    no join, so a host with a third of all rows costs what its rows cost.

    A null address, or one without ``://``, has an empty host and path and gets
    the default. Repeated rows are judged alike; an empty table gives no rows;
    the columns host, path, rule, verdict and pattern replace columns of the
    same name, other columns stay. The index is a literal of the plan, so rules
    beyond ``INDEX_BYTES`` are refused instead of being sent to every task.
    """
    rules = sorted(dict.fromkeys(rules))
    everything = {t for text, _ in rules for t in rule_tokens(text)} | {t for p in patterns for t in p[3]}
    if counts is None:
        counts = token_counts(pages, everything, url) if everything else {}
    placed = build_index(rules, patterns, counts)
    size = max(1, 2 * len(placed))
    spark = pages.sparkSession
    numbers = [r[0] for r in spark.createDataFrame([(p["token"],) for p in placed], "token string").select(
        F.pmod(F.xxhash64("token"), F.lit(size)).cast("int")).collect()] if placed else []
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for number, entry in zip(numbers, placed):
        buckets[number].append(entry)
    text = json.dumps(buckets)
    if len(text) > INDEX_BYTES:
        raise ValueError(f"the rule index has {len(text)} bytes, more than {INDEX_BYTES}; judge by parts of the rules")
    index = F.from_json(F.lit(text), T.ArrayType(T.ArrayType(_RULE)))

    clean = pages.drop(*[c for c in ("host", "path", "rule", "verdict", "pattern") if c != url])
    parsed = clean.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    subject = F.concat("host", "path")
    candidates = F.flatten(F.transform(
        url_tokens(F.col("host"), F.col("path")),
        lambda token: F.filter(
            F.element_at(index, (F.pmod(F.xxhash64(token), F.lit(size)) + 1).cast("int")),
            lambda r: r["token"] == token,
        ),
    ))
    fitting = F.filter(candidates, lambda r: F.call_function("regexp_like", subject, r["regex"]))
    best = F.get(F.array_sort(F.transform(fitting, lambda r: F.struct(
        (-r["weight"]).alias("w"), r["rule"].alias("rule"), r["action"].alias("action")))), F.lit(0))
    top = unused(parsed, "best")[0]
    judged = parsed.withColumn(top, best)
    return judged.withColumns({
        "rule": F.when(F.col(f"{top}.w") < 0, F.col(f"{top}.rule")),
        "verdict": F.coalesce(F.col(f"{top}.action"), F.lit(default)),
        "pattern": F.when(F.col(f"{top}.w") == 0, F.col(f"{top}.rule")),
    }).drop(top)
