from __future__ import annotations

import pytest

from paperloom.llm.licenses import TEMPLATES, find_licenses, rank_templates, scan_text


@pytest.mark.parametrize("line, name", [
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("licensed under CC BY 4.0", "CC-BY-4.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This library is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("Released under the MIT License.", "MIT"), ("Prose before. Released under the MIT License.", "MIT"),
    ("Copyright 2020 Someone. All rights reserved.", "Proprietary")])
def test_notices(line, name):
    found = scan_text(f"Some text.\n{line}\nMore text.")
    assert [f["license"] for f in found] == [name]
    shown = f"Some text.\n{line}\nMore text."[found[0]["start"] : found[0]["end"]]
    assert shown in line and shown


@pytest.mark.parametrize("text", ["", "A licence to print money.", "The license was revoked.", "permit and limit",
                                  "Licensed under the GNU General Public License, version 9."])
def test_no_notice(text):
    assert scan_text(text) == []


def test_every_template_wins_its_own_notice():
    for name, notice, _, _ in TEMPLATES:
        first = rank_templates(notice.split(". ")[0] + ".") or rank_templates(notice)
        assert next((n for _, n, sure in first if sure), None) == name or name == "Proprietary", name


def test_table(spark, docs, empty, texts):
    rows = [(1, "x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."), (2, None), (3, ""), (4, "none"),
            (5, "word " * 50000 + "\nReleased under the MIT License."), (1, "x\nReleased under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id, tuple(r.licenses)) for r in find_licenses(df).collect())
    assert got == [(1, ("CC-BY-NC-4.0", "MIT")), (1, ("MIT",)), (2, ()), (3, ()), (4, ()), (5, ("MIT",))]
    assert find_licenses(empty).collect() == [] and find_licenses(docs).count() == len(texts)
