"""Operator 4 - format-preserving pseudonyms for personal data by keyed Feistel permutations.

Found and validated values - cards (Luhn), IBANs (mod 97), social security numbers, telephone numbers, IPv4 and e-mail
addresses, dates, keys and passwords - are mapped within their own format: the value is a number in a mixed radix,
one digit per free character, a Feistel network with HMAC rounds permutes [0, N) by cycle walking, and the image is
written in the same layout with the same check digits. So equal values get equal pseudonyms in all documents, whatever
their separators - a day the same one in all layouts of dates - and who holds the key can go back. What fails its validation
stays as it is; telephone numbers and IPv4 addresses are valid by their layout, whether or not such a number can be assigned,
but not after words that say they are something else (a version, an ISBN). Of e-mail addresses the part before the @ is
mapped and the domain stays in clear, a personal domain too. The key has no default: see key_of().
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

KEY_NAME = "spark.cairn.pii.key"  # of the session's configuration; or CAIRN_PII_KEY of the driver's environment
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def key_of(spark: SparkSession, default: bytes | None = None) -> bytes:
    """The configured key, or default; raises if there is neither."""
    key = spark.conf.get(KEY_NAME, None) or os.environ.get("CAIRN_PII_KEY")
    if not key and default is None:
        raise ValueError(f"set {KEY_NAME} or CAIRN_PII_KEY")
    return key.encode() if key else default


@lru_cache(1 << 16)
def permute(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of [0, n), different for each tweak; back undoes it."""
    if n < 2:
        return x
    half = ((n - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1

    def f(i: int, r: int) -> int:
        mac = hmac.new(key, f"{tweak}|{n}|{i}|{r}".encode(), hashlib.sha256).digest()
        return int.from_bytes(mac, "big") & mask if half <= 256 else int.from_bytes(hashlib.shake_256(mac).digest(half // 8 + 1), "big") & mask

    while True:
        left, right = x >> half, x & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ f(i, left), left
            else:
                left, right = right, left ^ f(i, right)
        x = left << half | right
        if x < n:
            return x


def mixed(digits: list[int], radices: list[int], key: bytes, tweak: str, back: bool) -> list[int]:
    x, n = 0, 1
    for d, r in zip(digits, radices):
        x, n = x * r + d, n * r
    x = permute(x, n, key, tweak, back)
    out = []
    for r in reversed(radices):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def refill(text: str, digits: str) -> str:
    """text with its digits replaced, in order."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), text)


def numbers(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10


def card(text: str, key: bytes, back: bool) -> str | None:
    d = numbers(text)
    if not 13 <= len(d) <= 19 or luhn(d) or d[0] not in "23456" or len(set(d)) == 1:
        return None
    free = list(map(int, d[1:-1]))  # the scheme's digit stays, the check digit follows
    body = d[0] + "".join(map(str, mixed(free, [10] * len(free), key, f"card{len(d)}{d[0]}", back)))
    return refill(text, body + str(-luhn(body + "0") % 10))


def iban(text: str, key: bytes, back: bool) -> str | None:
    s = text.replace(" ", "").upper()
    as_number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(s) <= 34 or as_number(s[4:] + s[:4]) % 97 != 1:
        return None
    body = _alike(s[4:], key, f"iban{s[:2]}", back)
    out = iter(s[:2] + f"{98 - as_number(body + s[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(out) for c in text)


def ssn(text: str, key: bytes, back: bool) -> str | None:
    d = numbers(text)
    area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    a, g, s = mixed([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], key, "ssn", back)
    return refill(text, f"{a + 1 + (a >= 665):03d}{g + 1:02d}{s + 1:04d}")


def phone(text: str, key: bytes, back: bool) -> str | None:
    d = numbers(text)
    if not 8 <= len(d) <= 15:
        return None
    if len(d) == 10 and text[0] != "+" or len(d) == 11 and d[0] == "1":
        out = mixed(list(map(int, d[-10:])), [10] * 10, key, "phone", back)  # area codes and exchanges that nobody has too
        return refill(text, d[:-10] + "".join(map(str, out)))
    keep = 3 if text.startswith("+") else 1  # country code, or trunk digit
    free = list(map(int, d[keep:]))
    return refill(text, d[:keep] + "".join(map(str, mixed(free, [10] * len(free), key, f"phone{len(d)}{d[:keep]}", back))))


def ipv4(text: str, key: bytes, back: bool) -> str | None:
    o = list(map(int, text.split(".")))
    if max(o) > 255 or re.search(r"\b0[0-9]", text):  # 10.000.000.000 is a number in groups
        return None
    return ".".join(map(str, mixed(o, [256] * 4, key, "ipv4", back)))


def _alike(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Letters to letters of their case, digits to digits, all else stays."""
    where, digits, radices = [], [], []
    for i, c in enumerate(text):
        for first, r in (("0", 10), ("a", 26), ("A", 26)):
            if 0 <= ord(c) - ord(first) < r:
                where.append((i, first))
                digits.append(ord(c) - ord(first))
                radices.append(r)
    out = list(text)
    shape = "".join("0" if f == "0" else f for _, f in where)
    for (i, first), d in zip(where, mixed(digits, radices, key, f"{tweak}|{shape}", back)):
        out[i] = chr(ord(first) + d)
    return "".join(out)


def email(text: str, key: bytes, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{_alike(local, key, 'email', back)}@{domain}"


def secret(text: str, key: bytes, back: bool) -> str | None:
    if text.startswith("AKIA"):
        return "AKIA" + _alike(text[4:], key, "key", back)
    m = re.fullmatch(r"""(.*?[=:]\s*["']?)(.*)""", text, re.S)
    value = m[2]
    if re.fullmatch(r"[0-9a-f]+", value):
        v = mixed([int(c, 16) for c in value], [16] * len(value), key, f"hex{len(value)}", back)
        return m[1] + "".join("0123456789abcdef"[d] for d in v)
    return m[1] + _alike(value, key, "secret", back)


MONTHS = "january february march april may june july august september october november december".split()


def date(text: str, key: bytes, back: bool) -> str | None:
    """A valid day of 1900-2099 in a numeric or English layout; the day of an ambiguous layout is read month first where
    that is valid. Days up to the 12th have such images, and so have later ones, so that the image reads as the same day in every
    layout. The image keeps order, separators and the month's style, and the widths of day and month where they fit: the
    way back gives the same day, though perhaps with a zero before it, or May's month in the other style."""
    parts = re.split(r"([^0-9A-Za-z]+)", text)
    fields, seps = parts[::2], parts[1::2]
    word = next((i for i, f in enumerate(fields) if f.isalpha()), None)
    orders = ["ymd"] if len(fields[0]) == 4 and word is None else ["mdy"] if word == 0 else ["dmy"] if word == 1 else ["mdy", "dmy"]
    for order in orders:
        f = dict(zip(order, fields))
        month = next((i + 1 for i, m in enumerate(MONTHS) if word is not None and m.startswith(f["m"].lower())), 0) if word is not None else int(f["m"])
        try:
            day = datetime.date(int(f["y"]), month, int(f["d"])).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            break
    else:
        return None
    span = LAST_DAY - FIRST_DAY + 1
    early = int(f["d"]) <= 12
    x = day - FIRST_DAY
    while True:
        x = permute(x, span, key, "date", back)
        new = datetime.date.fromordinal(FIRST_DAY + x)
        if (new.day <= 12) == early:
            break
    values = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(f['m'])}d}" if word is None else _styled(f["m"], new.month), "d": f"{new.day:0{len(f['d'])}d}"}
    out = [values[c] for c in order]
    return out[0] + "".join(s + v for s, v in zip(seps, out[1:]))


def _styled(like: str, month: int) -> str:
    name = MONTHS[month - 1]
    name = name[:3] if len(like) == 3 and like.lower() != "may" else name
    return name.upper() if like.isupper() else name.capitalize() if like[0].isupper() else name


_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + ")"
#: Kind, mapping, pattern; of values that begin at one place the first kind that validates counts.
KINDS = [
    ("email", email, r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}\b"),
    ("secret", secret, r"""(?:\bAKIA[0-9A-Z]{16}\b|\b(?i:password|passwd|token|secret|api_key|apikey)\s*[=:]\s*["']?[A-Za-z0-9_/+-]{8,})"""),
    ("iban", iban, r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ipv4", ipv4, r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("date", date, rf"(?<![0-9/.-])(?:[0-9]{{4}}([-/.])[0-9]{{1,2}}\1[0-9]{{1,2}}|[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\2[0-9]{{4}}|(?i:{_MONTH})\.? [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{1,2}} (?i:{_MONTH})\.? [0-9]{{4}})(?![0-9]|[-/.][0-9])"),
    ("ssn", ssn, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"),
    ("card", card, r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])"),
    ("phone", phone, r"(?<![0-9A-Za-z+])(?:(?:\+?1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?:\+?1[ .-])?[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6})(?![0-9])"),
]
_HINT = re.compile(r"[0-9@]|AKIA|(?i:password|passwd|token|secret|api_?key)")
_PATTERNS = [(kind, f, re.compile(p)) for kind, f, p in KINDS]
#: What a value is not after such words, in the text just before it.
_NOT_AFTER = {"ipv4": re.compile(r"(?i:\b(?:version|release|build|ver|v)[.:]?\s*)\Z"), "phone": re.compile(r"(?i:\b(?:isbn|issn|ean|isbn-1[03])[.:]?\s*)\Z")}
_BEFORE = 16


def pseudonymise(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, int]:
    """The text with its values mapped, and their number, in time linear in the text. A place is claimed by the first kind that
    validates there; nothing claimed is looked at again. Null stays null."""
    if not text or not _HINT.search(text):
        return text, 0
    spans: list[tuple[int, int, str]] = []
    claimed = bytearray(len(text))
    for kind, f, pattern in _PATTERNS:
        other = _NOT_AFTER.get(kind)
        for m in pattern.finditer(text):
            a, b = m.span()
            if claimed.find(1, a, b) >= 0 or other and other.search(text[max(0, a - _BEFORE) : a]):
                continue
            if (new := f(m[0], key, back)) is not None:
                spans.append((a, b, new))
                claimed[a:b] = b"\1" * (b - a)
    out, at = [], 0
    for a, b, new in sorted(spans):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), len(spans)


def pseudonymise_docs(docs: DataFrame, key: bytes, count: str | None = None) -> DataFrame:
    """docs with their text mapped, all other columns and all rows, repeated ones too, as they are, whatever their names; count
    names a column for the number of values in the text (it must not be there yet). Null and empty texts stay; an empty
    table stays empty."""
    from pyspark.sql import types as T

    text = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *([T.StructField(count, T.LongType())] if count else [])])

    def run(batches):
        for b in batches:
            new = [pseudonymise(t, key) for t in b.column(text).to_pylist()]
            columns = list(b.columns)
            columns[text] = pa.array([t for t, _ in new], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array([n for _, n in new], pa.int64())] if count else [])], names=schema.names)

    return docs.mapInArrow(run, schema)
