"""Format-preserving Feistel pseudonyms for validated numbers and dates (operator 10)."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)

#: What may be personal; each find is validated before it is replaced.
CANDIDATES = re.compile(
    r"(?P<email>[A-Za-z0-9_.+%-]*[A-Za-z0-9_+%-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<secret>(?<![0-9A-Za-z])[0-9a-f]{32,128}(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9]))"
    r"|(?P<iso>(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]))"
    r"|(?P<dmy>(?<![0-9])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]))")


def permute(value: int, size: int, key: bytes, tweak: bytes, fits: Callable[[int], bool] = lambda _: True) -> int:
    """Keyed permutation of 0..size-1: a Feistel network over a grid that just holds them.

    Values outside the range, or not fitting, are permuted again, which keeps it
    a permutation of the fitting values.
    """
    if size < 2:
        return value
    side = 1
    while side * side < size:
        side *= 2
    side = max(2, side)
    while True:
        left, right = divmod(value, side)
        for r in range(ROUNDS):
            digest = hashlib.blake2b(f"{r},{size},{right}".encode() + tweak, key=key, digest_size=16).digest()
            left, right = right, (left + int.from_bytes(digest)) % side
        value = left * side + right
        if value < size and fits(value):
            return value


def luhn_digit(payload: str) -> str:
    total = 0
    for i, d in enumerate(reversed(payload)):
        n = int(d) * (2 - i % 2)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _refill(pattern: str, characters: str) -> str:
    """``characters`` in the places of the letters and digits of ``pattern``."""
    rest = iter(characters)
    return "".join(next(rest) if c.isalnum() else c for c in pattern)


def _digits(text: str, key: bytes, kind: str, fits=lambda _: True) -> str:
    n = len(text)
    return str(permute(int(text), 10**n, key, kind.encode(), fits)).zfill(n)


def _mixed(text: str, key: bytes, tweak: str) -> str:
    """Letters to letters and digits to digits, by their classes."""
    alphabets = [next((a for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in a), c)
                 for c in text]
    value, size = 0, 1
    for c, a in zip(text, alphabets):
        value, size = value * len(a) + a.index(c), size * len(a)
    value = permute(value, size, key, tweak.encode())
    out = []
    for a in reversed(alphabets):
        value, i = divmod(value, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def card(text: str, key: bytes) -> str | None:
    digits = "".join(c for c in text if c.isdigit())
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    payload = _digits(digits[:-1], key, "card")
    return _refill(text, payload + luhn_digit(payload))


def phone(text: str, key: bytes) -> str | None:
    """The ten national digits are permuted, the country code stays."""
    digits = "".join(c for c in text if c.isdigit())
    return _refill(text, digits[:-10] + _digits(digits[-10:], key, "phone" + digits[:-10]))


def ip(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    value = permute(int.from_bytes(bytes(octets)), 1 << 32, key, b"ip")
    return ".".join(map(str, value.to_bytes(4)))


def _day(year: int, month: int, day: int, key: bytes) -> datetime.date | None:
    try:
        date = datetime.date(year, month, day)
    except ValueError:
        return None
    if not FIRST_DAY <= date <= LAST_DAY:
        return None
    return FIRST_DAY + datetime.timedelta(
        permute((date - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, key, b"date"))


def iso(text: str, key: bytes) -> str | None:
    date = _day(*map(int, text.split("-")), key)
    return date and date.isoformat()


def dmy(text: str, key: bytes) -> str | None:
    day, month, year = (int(text[a:b]) for a, b in ((0, 2), (3, 5), (6, 10)))
    date = _day(year, month, day, key)
    return date and f"{date.day:02d}{text[2]}{date.month:02d}{text[5]}{date.year:04d}"


def ssn(text: str, key: bytes) -> str | None:
    def valid(n: int) -> bool:
        area, group, serial = n // 10**6, n // 10**4 % 100, n % 10**4
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    digits = text.replace("-", "")
    if not valid(int(digits)):
        return None
    return _refill(text, _digits(digits, key, "ssn", valid))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if _mod97(plain[4:] + plain[:4]) != 1:
        return None
    account = _mixed(plain[4:], key, "iban" + plain[:2])
    check = 98 - _mod97(account + plain[:2] + "00")
    return _refill(text, f"{plain[:2]}{check:02d}{account}")


def email(text: str, key: bytes) -> str | None:
    """The part before the @ is permuted, the domain stays."""
    local, _, domain = text.partition("@")
    return f"{_mixed(local, key, 'email' + domain.lower())}@{domain}"


def secret(text: str, key: bytes) -> str | None:
    """Hexadecimal keys with letters and digits."""
    if text.isdigit() or text.isalpha():
        return None
    return f"{permute(int(text, 16), 16 ** len(text), key, b'secret'):0{len(text)}x}"


_BY_KIND = {"email": email, "secret": secret, "iban": iban, "phone": phone, "iso": iso, "dmy": dmy, "ip": ip, "ssn": ssn,
            "card": card}


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was replaced, in the original text."""
    if not re.search("[0-9@]", text):
        return text, []
    out, found, done, at = [], [], 0, 0
    while match := CANDIDATES.search(text, at):
        kind = match.lastgroup
        new = _BY_KIND[kind](match.group(), key)
        if new is None:
            # What failed as one kind may hold another that begins further on.
            at = match.start() + 1
            while at < match.end() and text[at].isalnum() and text[at - 1].isalnum():
                at += 1
            continue
        out += [text[done : match.start()], new]
        found.append((kind, match.start(), match.end()))
        done = at = match.end()
    return "".join([*out, text[done:]]), found


def replace_personal_data(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced, spans), one row per row of ``docs``.

    Card numbers (Luhn), IBANs (mod 97), dates of 1900-2099, IPv4 addresses,
    social security and telephone numbers, e-mail addresses and hexadecimal keys
    are replaced by a keyed permutation of their own format: valid stays valid,
    and equal values get equal pseudonyms in all documents without any table or
    shuffle. Numbers that fail validation stay as they are. ``spans`` are kind,
    start and end in the original text.

    A null text stays null with no spans. Repeated rows give the same text again;
    an empty table gives no rows; other columns are not read.
    """
    if not 16 <= len(key) <= 64:
        raise ValueError("the key must have 16 to 64 bytes")

    def work(batches):
        for batch in batches:
            texts, counts, spans = [], [], []
            for value in batch.column(1).to_pylist():
                new, found = pseudonymise(value, key) if value is not None else (None, [])
                texts.append(new)
                counts.append(len(found))
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(pa.struct(
                    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "text", "n_replaced", "spans"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(work, (
        f"doc_id {dict(picked.dtypes)['doc_id']}, text string, n_replaced long, "
        "spans array<struct<kind:string,start:long,end:long>>"))
