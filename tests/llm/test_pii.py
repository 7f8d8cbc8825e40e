from __future__ import annotations

import datetime
import random

import pytest

from paperloom.llm.pii import luhn_digit, permute, pseudonymise, replace_personal_data

KEY = b"0123456789abcdef"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 4096])
def test_permutation(size):
    assert sorted(permute(i, size, KEY, b"t") for i in range(size)) == list(range(size))


def test_permutation_of_fitting_values():
    odd = [permute(i, 100, KEY, b"t", lambda n: n % 2 == 1) for i in range(1, 100, 2)]
    assert sorted(odd) == list(range(1, 100, 2))


def test_every_kind_keeps_its_format():
    card = "453201511283036"
    text = (f"Card {card}{luhn_digit(card)}, +1 (377) 555-0271, 192.168.0.1; 2024-02-29 and 29.02.2024, SSN 123-45-6789,"
            " GB82 WEST 1234 5698 7654 32, und.34@mail7.example.com token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"")
    new, found = pseudonymise(text, KEY)
    assert [k for k, _, _ in found] == ["card", "phone", "ip", "iso", "dmy", "ssn", "iban", "email", "secret"]
    again, kinds = pseudonymise(new, KEY)
    assert [k for k, _, _ in kinds] == [k for k, _, _ in found]
    for kind, a, b in found:
        assert text[a:b] not in new, kind
    assert pseudonymise(text, KEY)[0] == new and pseudonymise(text, b"another key......")[0] != new
    # One day has one pseudonym, however it is written.
    iso = next(m for k, m, _ in kinds if k == "iso")
    dmy = next(m for k, m, _ in kinds if k == "dmy")
    day = datetime.date.fromisoformat(again and new[iso : iso + 10])
    assert new[dmy : dmy + 10] == day.strftime("%d.%m.%Y")


@pytest.mark.parametrize("text", [
    "", "no numbers", "4845168114407320", "999.1.1.1", "2023-02-29", "32.01.2000", "000-12-3456", "page 12 of 300",
    "GB82 WEST 1234 5698 7654 33", "1.2.3.4.5", "12345678901234567890123", "a@b", "f" * 40, "1" * 40])
def test_what_fails_validation_stays(text):
    assert pseudonymise(text, KEY) == (text, [])


def test_a_find_after_a_failed_one():
    new, found = pseudonymise("4845168114407320 4845168114407329 999.1.1.1 8.8.8.8", KEY)
    assert [k for k, _, _ in found] == ["card", "ip"] and new.startswith("4845168114407320 ")


def test_equal_values_stay_linked_across_documents(spark, docs, empty, texts):
    rows = [(1, "see 8.8.8.8"), (2, "ping 8.8.8.8 now"), (3, None), (4, "x" * 200000 + " 8.8.8.8"), (1, "see 8.8.8.8")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = replace_personal_data(df, KEY).collect()
    values = {r.text.split("see ")[-1].split("ping ")[-1].split(" ")[-1 if r.doc_id == 4 else 0] for r in got if r.text}
    assert len(values) == 1 and "8.8.8.8" not in values
    assert [r.n_replaced for r in got if r.doc_id == 3] == [0]
    assert replace_personal_data(empty, KEY).collect() == []
    assert replace_personal_data(docs, KEY).count() == len(texts)
    with pytest.raises(ValueError):
        replace_personal_data(docs, b"short")


def test_distinct_values_get_distinct_pseudonyms():
    rnd = random.Random(1)
    numbers = {"".join(rnd.choice("0123456789") for _ in range(15)) for _ in range(300)}
    cards = {n + luhn_digit(n) for n in numbers}
    assert len({pseudonymise(c, KEY)[0] for c in cards}) == len(cards)
