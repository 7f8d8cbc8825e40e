"""License scan by conditional compression (operator 2)."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (license, its usual notice, words that set it apart from its relatives, words that only a relative has).
TEMPLATES = (
    ("MIT", "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a "
            "copy of this software and associated documentation files.", ("mit",), ()),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance "
                   "with the License.", ("apache", "2.0"), ()),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public", "2"),
     ("lesser", "affero")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public", "3"),
     ("lesser", "affero")),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1.",
     ("gnu lesser general public", "2.1"), ()),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3.",
     ("gnu lesser general public", "3"), ()),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.",
     ("gnu affero general public", "3"), ()),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
     ("mozilla public", "2.0"), ()),
    ("BSD-2-Clause", "Licensed under the 2-Clause BSD License.", ("bsd", "2-clause"), ()),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License.", ("bsd", "3-clause"), ()),
    ("CC0-1.0", "Released under CC0 1.0 Universal public domain dedication license.", ("cc0",), ()),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", ("by", "4.0"), ("nc", "sa", "nd")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("by", "sa", "4.0"), ("nc", "nd")),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", ("by", "nd", "4.0"), ("nc", "sa")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("by", "nc", "4.0"), ("sa", "nd")),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", ("by", "nc", "sa", "4.0"), ("nd",)),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.", ("by", "nc", "nd", "4.0"), ("sa",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain; see the Unlicense.",
     ("unlicense",), ()),
    ("Proprietary", "Copyright. All rights reserved.", ("all rights reserved",), ()),
)
#: A line with one of these may be a notice.
TRIGGER = r"(?i)licen[sc]|released under|rights reserved|public domain|creative commons|spdx|copyright|\bcc0\b|\bcc by\b"
#: Least share of a block's compressed size that a template must save to be looked at.
LEAST_SAVING = 0.15


def notice_words(text: str, split_parts: bool) -> str:
    """Lower-case words; the parts of identifiers such as BY-NC stand alone unless they begin with a digit."""
    found = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())
    if split_parts:
        found = [p for w in found for p in ([w] if w[0].isdigit() else w.split("-"))]
    return f" {' '.join(found)} "


@functools.cache
def _tools():
    plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
    tools = []
    for name, notice, needed, foreign in TEMPLATES:
        dictionary = zstandard.ZstdCompressionDict(notice.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tools.append((name, needed, foreign, zstandard.ZstdCompressor(
            level=19, dict_data=dictionary, write_content_size=False, write_dict_id=False)))
    return plain, tools


def rank_templates(block: str) -> list[tuple[float, str, bool]]:
    """(share saved, license, confirmed) by what the template saves as a dictionary, best first.

    A license is confirmed when the block has all words that set it apart and
    none that only a relative has.
    """
    plain, tools = _tools()
    data = block.lower().encode("utf-8", "replace")
    alone = len(plain.compress(data))
    words = notice_words(block, True)
    ranked = []
    for name, needed, foreign, squeeze in tools:
        saved = 1 - len(squeeze.compress(data)) / alone
        if saved >= LEAST_SAVING:
            sure = all(f" {w} " in words for n in needed for w in (n.split() if "-" not in n else [n]))
            sure = sure and all(f" {n} " in words for n in needed) and not any(f" {w} " in words for w in foreign)
            ranked.append((saved, name, sure))
    return sorted(ranked, key=lambda r: (-r[0], r[1]))


def scan_text(text: str) -> list[dict]:
    """The licensed blocks of a text: the first confirmed template of each candidate line."""
    out = []
    if not re.search(TRIGGER, text):
        return out
    for line in re.finditer(r"[^\n]+", text):
        if re.search(TRIGGER, line.group()):
            # Sentences of a line are blocks of their own: a notice may follow prose.
            for part in re.finditer(r"(?:[^.!?]|[.](?=[0-9]))+[.!?]*", line.group()):
                if not re.search(TRIGGER, part.group()):
                    continue
                ranked = rank_templates(part.group().strip())
                best = next((r for r in ranked if r[2]), None)
                if best:
                    lead = len(part.group()) - len(part.group().lstrip())
                    begin = line.start() + part.start() + lead
                    out.append({"license": best[1], "start": begin, "end": begin + len(part.group().strip()),
                                "saving": round(best[0], 4), "place": ranked.index(best) + 1})
    return out


def find_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, licenses, notices), one row per row of ``docs``.

    Lines with a trigger word are cut into sentences; each is compressed with
    every template as raw zstandard dictionary, the templates are ranked by the
    share of the compressed size they save, and the first one whose exact wording
    fits is the block's license. ``notices`` holds license, start, end, saving
    and the rank of the confirmed template; ``licenses`` the distinct names,
    sorted. Rows are scanned where they lie.

    A null or empty text has none. Repeated rows give the same result again; an
    empty table gives no rows; other columns are not read.
    """
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                               ("saving", pa.float64()), ("place", pa.int32())]))

    def work(batches):
        for batch in batches:
            found = [scan_text(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([sorted({x["license"] for x in f}) for f in found], pa.list_(pa.string())),
                pa.array(found, kind)], ["doc_id", "licenses", "notices"])

    picked = docs.select(F.col(doc_id).alias("doc_id"),
                         F.when(F.col(text).rlike(TRIGGER), F.col(text)).alias("text"))
    return picked.mapInArrow(work, (
        f"doc_id {dict(picked.dtypes)['doc_id']}, licenses array<string>, "
        "notices array<struct<license:string,start:long,end:long,saving:double,place:int>>"))
