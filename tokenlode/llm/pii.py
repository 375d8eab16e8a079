"""Personal data replaced by format-preserving pseudonyms.

What is found and validated is enciphered within its own format by a keyed
Feistel network over the numbers below the format's count, walking its
cycles until the outcome is in range. So a card number becomes a card number
that passes the same check, a date a date, and a value becomes the
same pseudonym wherever it occurs, in whatever case; without the key it can't
be turned back. With the key `reveal` does.

Kinds: card and account numbers of 13 to 19 digits that pass Luhn's check, and so do
their pseudonyms (other numbers are no such ones and stay), phone numbers (country code kept),
social security numbers (valid ranges), IBANs (check digits made anew), IPv4
addresses, dates from 1900 to 2099 (in their notation), e-mail addresses
(letters and digits of all but the top two labels) and hexadecimal
secrets of 32 digits or more.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, named

#: The key of the registered query; real ones are secrets passed in.
KEY = "tokenlode"
ROUNDS = 8
KINDS = ("email", "secret", "iban", "ip", "date", "ssn", "phone", "card")

_DATES = (datetime.date(1900, 1, 1), datetime.date(2099, 12, 31))
_SPAN = (_DATES[1] - _DATES[0]).days + 1

FOUND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<date>(?<![\w/.-])(?:\d{4}([-/.])\d{1,2}\6\d{1,2}|\d{1,2}([-/.])\d{1,2}\7\d{4})(?!(?!T\d)[\w/-]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+(?!1[ .-]?\(?\d{3}\)?[ .-])\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|[.-]\d))"
    r"|(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,}(?![\w]|[.-]\d))"
)
#: A text without this has nothing to find.
MAYBE = re.compile(r"[0-9@]|[A-Fa-f]{32}")


class Cipher:
    """Keyed permutations of range(n), by kind and n."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, x: int, bits: int) -> int:
        size = (bits + 7) // 8
        h = hashlib.blake2b(x.to_bytes(size, "big"), digest_size=min(64, size + 8), key=self.key, salt=hashlib.blake2b(tweak + bytes([i]), digest_size=16).digest())
        d, k = h.digest(), 0
        while len(d) < size:
            k += 1
            d += hashlib.blake2b(h.digest() + bytes([k]), digest_size=64, key=self.key).digest()
        return int.from_bytes(d, "big") & ((1 << bits) - 1)

    def _once(self, tweak: bytes, x: int, half: int, back: bool) -> int:
        left, right = x >> half, x & ((1 << half) - 1)
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(tweak, i, left, half), left
            else:
                left, right = right, left ^ self._round(tweak, i, right, half)
        return left << half | right

    def permute(self, tweak: str, x: int, n: int, back: bool = False) -> int:
        half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
        t = f"{tweak}:{n}".encode()
        while True:
            x = self._once(t, x, half, back)
            if x < n:
                return x


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _luhn_digit(body: str) -> str:
    return next(c for c in "0123456789" if luhn(body + c))


def _fill(form: str, chars: str, at: str) -> str:
    """chars put in form's places for characters of the kind at."""
    it = iter(chars)
    return "".join(next(it) if c in at else c for c in form)


DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def _mixed(c: Cipher, tweak: str, s: str, back: bool) -> str:
    """Digits to digits and letters to letters of the same case, as one number."""
    x, n = 0, 1
    for ch in s:
        a = DIGITS if ch in DIGITS else LETTERS if ch.lower() in LETTERS else ""
        if a:
            x, n = x * len(a) + a.index(ch.lower()), n * len(a)
    y, out = c.permute(tweak, x, n, back), []
    for ch in reversed(s):
        a = DIGITS if ch in DIGITS else LETTERS if ch.lower() in LETTERS else ""
        if a:
            y, r = divmod(y, len(a))
            out.append(a[r].upper() if ch.isupper() else a[r])
        else:
            out.append(ch)
    return "".join(reversed(out))


#: Digits of the groups that a number is written in, if it isn't written in one.
SHAPES = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4))


def _numbers(s: str) -> list[tuple[int, int]]:
    """Where numbers stand in digits parted by spaces and hyphens. Only the lengths of groups decide, so that it is the same for pseudonyms."""
    groups, out, k = [m.span() for m in re.finditer(r"\d+", s)], [], 0
    while k < len(groups):
        n = next((len(x) for x in SHAPES if tuple(b - a for a, b in groups[k : k + len(x)]) == x), int(13 <= groups[k][1] - groups[k][0] <= 19))
        if n:
            out.append((groups[k][0], groups[k + n - 1][1]))
        k += n or 1
    return out or [(0, len(s))] * (13 <= sum(b - a for a, b in groups) <= 19)


def _card(c: Cipher, s: str, back: bool) -> str | None:
    out, at = [], 0
    for a, b in _numbers(s):
        d = re.sub(r"\D", "", s[a:b])
        if luhn(d):
            n = len(d) - 1
            body = f"{c.permute('card', int(d[:-1]), 10**n, back):0{n}d}"
            out += [s[at:a], _fill(s[a:b], body + _luhn_digit(body), DIGITS)]
            at = b
    return "".join(out) + s[at:] if out else None


def _phone(c: Cipher, s: str, back: bool) -> str | None:
    code = re.match(r"\+\d{1,3}(?=\D)", s)
    head = code.group() if code else ""
    rest = s[len(head) :]
    d = re.sub(r"\D", "", rest)
    if not 7 <= len(d) + len(re.sub(r"\D", "", head)) <= 15 or len(d) < 5:
        return None
    return head + _fill(rest, f"{c.permute('phone', int(d), 10 ** len(d), back):0{len(d)}d}", DIGITS)


def _ssn(c: Cipher, s: str, back: bool) -> str | None:
    a, g, n = map(int, s.split("-"))
    if a in (0, 666) or a >= 900 or not g or not n:
        return None
    a -= 1 + (a > 666)
    y = c.permute("ssn", (a * 99 + g - 1) * 9999 + n - 1, 898 * 99 * 9999, back)
    y, n = divmod(y, 9999)
    a, g = divmod(y, 99)
    a += 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{n + 1:04d}"


def _ip(c: Cipher, s: str, back: bool) -> str | None:
    o = s.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in o):
        return None
    y = c.permute("ip", int.from_bytes(bytes(map(int, o)), "big"), 1 << 32, back)
    return ".".join(map(str, y.to_bytes(4, "big")))


def _date(c: Cipher, s: str, back: bool) -> str | None:
    sep = re.search(r"[-/.]", s).group()
    p = s.split(sep)
    first = len(p[0]) == 4
    year, x, y = (int(p[0]), int(p[1]), int(p[2])) if first else (int(p[2]), int(p[0]), int(p[1]))
    # a year in front is followed by the month; else points mean the day first, and so does a first number over 12
    month_first = first or (sep != "." and x <= 12)
    try:
        day = datetime.date(year, *((x, y) if month_first else (y, x)))
    except ValueError:
        return None
    if not _DATES[0] <= day <= _DATES[1]:
        return None
    n = (day - _DATES[0]).days
    while True:
        n = c.permute("date", n, _SPAN, back)
        new = _DATES[0] + datetime.timedelta(n)
        # as many digits, and read the same way round
        parts = [new.month, new.day] if month_first else [new.day, new.month]
        wide = [len(p[1]), len(p[2])] if first else [len(p[0]), len(p[1])]
        fits = all(w == 2 or v < 10 for w, v in zip(wide, parts))
        if fits and (first or month_first or sep == "." or new.day > 12):
            break
    text = [f"{v:0{w}d}" for v, w in zip(parts, wide)]
    return sep.join([f"{new.year}", *text] if first else [*text, f"{new.year}"])


def _iban_sum(s: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in s[4:] + s[:4])) % 97


def _iban(c: Cipher, s: str, back: bool) -> str | None:
    d = s.replace(" ", "")
    if not 15 <= len(d) <= 34 or _iban_sum(d) != 1:
        return None
    body = _mixed(c, "iban", d[4:], back)
    check = 98 - _iban_sum(d[:2] + "00" + body)
    return _fill(s, d[:2] + f"{check:02d}" + body.upper(), DIGITS + LETTERS.upper())


def _email(c: Cipher, s: str, back: bool) -> str | None:
    labels = s.split("@")[1].split(".")
    keep = len(".".join(labels[-2:]))
    return _mixed(c, "email", s[: len(s) - keep], back) + s[len(s) - keep :]


def _secret(c: Cipher, s: str, back: bool) -> str | None:
    if s.isdigit() or s.isalpha():
        return None
    y = f"{c.permute('secret', int(s, 16), 16 ** len(s), back):0{len(s)}x}"
    return y.upper() if s.isupper() else y


_BY = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def replace(text: str, cipher: Cipher, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    found: dict[str, int] = {}
    if not MAYBE.search(text):
        return text, found

    def one(m: re.Match) -> str:
        kind = m.lastgroup if m.lastgroup in _BY else next(k for k in KINDS if m.group(k) is not None)
        new = _BY[kind](cipher, m.group(), back)
        if new is None:
            return m.group()
        found[kind] = found.get(kind, 0) + 1
        return new

    return FOUND.sub(one, text), found


def reveal(text: str, key: str) -> str:
    """The text as it was before `replace` with this key."""
    return replace(text, Cipher(key), back=True)[0]


def pseudonymise(docs: DataFrame, key: str = KEY, text_col: str = "text") -> DataFrame:
    """docs with pseudonyms in the text, and ``pii`` (map of kind to count) behind its columns.

    A null text stays null with a null map; an empty one, or one with nothing
    to find, stays as it is, byte for byte, with an empty map. What looks like
    a kind but isn't valid stays (an address octet over 255, a 31 April, a number that fails its check).
    An empty table gives an empty one.
    Texts of any length are searched whole. Repeated rows stay repeated; a column of docs
    already named pii gets an underscore in front.
    """
    for c in docs.columns:
        if c.lower() == "pii":
            docs = docs.withColumnRenamed(c, fresh(docs, "_" + c)[0])

    @F.pandas_udf("text string, pii map<string,int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cipher = Cipher(key)
        for b in batches:
            got = [(None, None) if t is None else replace(t, cipher) for t in b]
            yield pd.DataFrame({"text": [g[0] for g in got], "pii": [g[1] for g in got]})

    r = fresh(docs, "replaced__")[0]
    out = docs.withColumn(r, run(named(docs, text_col).cast("string")))
    cols = [F.col(r + ".text").alias(c) if c == text_col else named(out, c) for c in docs.columns]
    return out.select(*cols, F.col(r + ".pii").alias("pii"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
