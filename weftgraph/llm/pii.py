"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation.

Each kind of value is checked (check digits, octets, calendar) and read as a number below the size of its
format's value set; the permutation of those numbers is written back in the same format, with the same
separators and letter case. So equal values get equal pseudonyms in every document, different values stay
different, and the key gets the values back. A pseudonym never equals its value: x goes to
P^-1(P(x) + 1), a keyed permutation without fixed points. Only beside digits or letters that could belong to a
card or an IBAN that step may be repeated, until no longer reading of the place is valid either: so the key
always gets the value back, while such a value can get another pseudonym than it has elsewhere.

Defined results: a null or empty text stays as it is and has no spans, as do texts without findings; where kinds
overlap, the first in KINDS wins; rows, repeated ones too, and extra columns are kept whatever their names, and a
column that has the name of an output is replaced; an empty table gives no rows. Everything is local to a row: no
shuffle, and memory for a few megabytes of texts or a longer one alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from datetime import date, timedelta
from functools import lru_cache
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftgraph.llm.shared import pieces

ROUNDS = 8
#: Bits of the widest value that is permuted as one number: what a digest holds.
WIDE = 896
LETTERS, UPPER, DIGITS, HEX, BASE32 = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


class Permutation:
    """A keyed permutation of range(size): a Feistel network on the next even number of bits, walked along
    its cycles until it is back in range."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.base = hashlib.blake2b(tweak.encode() + b"|" + str(size).encode(), key=key[:64], digest_size=(self.half + 7) // 8 + 8)

    def _round(self, k: int, x: int) -> int:
        h = self.base.copy()
        h.update(bytes([k]) + x.to_bytes((self.half + 7) // 8, "big"))
        return int.from_bytes(h.digest(), "big") & self.mask

    def forth(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for k in range(ROUNDS):
                left, right = right, left ^ self._round(k, right)
            x = left << self.half | right
            if x < self.size:
                return x

    def back(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for k in reversed(range(ROUNDS)):
                left, right = right ^ self._round(k, left), left
            x = left << self.half | right
            if x < self.size:
                return x

    def pseudonym(self, x: int) -> int:
        return self.back((self.forth(x) + 1) % self.size)

    def value(self, x: int) -> int:
        return self.back((self.forth(x) - 1) % self.size)


class WidePermutation:
    """The same for values beyond WIDE bits, as lists of digits in mixed bases: the halves are added to each other's
    digits, hashed to any width, so time grows with the length alone."""

    def __init__(self, key: bytes, tweak: str, bases: list[int]):
        self.bases = bases
        self.free = [k for k, b in enumerate(bases) if b > 1]
        cut = len(self.free) // 2
        self.halves = self.free[:cut], self.free[cut:]
        self.base = hashlib.blake2b(tweak.encode(), key=key[:64]).digest()

    def _add(self, x: list[int], k: int, sign: int) -> None:
        from_, to = self.halves[k % 2], self.halves[1 - k % 2]
        stream = hashlib.shake_256(self.base + bytes([k]) + bytes(x[p] for p in from_)).digest(8 * len(to))
        for n, p in enumerate(to):
            x[p] = (x[p] + sign * int.from_bytes(stream[8 * n : 8 * n + 8], "big")) % self.bases[p]

    def _moved(self, x: list[int], step: int) -> list[int]:
        x = list(x)
        for k in range(ROUNDS):
            self._add(x, k, 1)
        for p in reversed(self.free):  # plus or minus one, with its carry
            x[p] = (x[p] + step) % self.bases[p]
            if x[p] != (0 if step > 0 else self.bases[p] - 1):
                break
        for k in reversed(range(ROUNDS)):
            self._add(x, k, -1)
        return x

    def pseudonym(self, x: list[int]) -> list[int]:
        return self._moved(x, 1)

    def value(self, x: list[int]) -> list[int]:
        return self._moved(x, -1)


def luhn(digits: str) -> int:
    """The check digit that belongs behind the digits."""
    total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return -total % 10


def _verhoeff_tables():
    """The dihedral group of order 10 and the powers of its permutation, from their rules."""
    step = [[(a + b) % 5 if a < 5 and b < 5 else (a + (b - 5)) % 5 + 5 if a < 5 else (a - 5 - b) % 5 + 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
    swap = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([swap[x] for x in powers[-1]])
    return step, powers


STEP, POWERS = _verhoeff_tables()


def verhoeff(digits: str) -> int:
    """The check digit that belongs behind the digits."""
    c = 0
    for k, d in enumerate(reversed(digits), 1):
        c = STEP[c][POWERS[k % 8][int(d)]]
    return next(x for x in range(10) if STEP[c][x] == 0)


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _mixed(text: str, alphabets: list[str]) -> tuple[int, int]:
    """(number, size) of the characters, each a digit in the base of its alphabet."""
    n, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        n, size = n * len(a) + a.index(c), size * len(a)
    return n, size


def _unmixed(n: int, alphabets: list[str]) -> str:
    out = []
    for a in reversed(alphabets):
        n, k = divmod(n, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def _by_class(text: str) -> list[str]:
    return [DIGITS if c in DIGITS else UPPER if c in UPPER else LETTERS for c in text]


# A reader gives (tweak, number, size, write) of a value of its kind, or None if the value isn't valid.
# Beyond WIDE bits number and size are lists: the digits and their bases.


def _fill(shape: str, digits: str) -> str:
    """The digits of shape replaced one after another."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in shape)


def read_card(v):
    d = re.sub(r"\D", "", v)
    if not 13 <= len(d) <= 19 or d[0] not in "23456" or luhn(d[:-1]) != int(d[-1]):
        return None
    n, size = int(d[1:-1]), 10 ** (len(d) - 2)

    def write(x):
        body = d[0] + str(x).zfill(len(d) - 2)
        return _fill(v, body + str(luhn(body)))

    return f"card{d[0]}", n, size, write


def read_aadhaar(v):
    d = re.sub(r"\D", "", v)
    if len(d) != 12 or d[0] in "01" or verhoeff(d[:-1]) != int(d[-1]):
        return None

    def write(x):
        body = str(x + 2 * 10**10)
        return _fill(v, body + str(verhoeff(body)))

    return "aadhaar", int(d[:-1]) - 2 * 10**10, 8 * 10**10, write


def read_ssn(v):
    d = re.sub(r"\D", "", v)
    area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    k = area - 1 - (area > 666)

    def write(x):
        x, s = divmod(x, 9999)
        x, g = divmod(x, 99)
        a = x + 1 + (x >= 665)
        return _fill(v, f"{a:03d}{g + 1:02d}{s + 1:04d}")

    return "ssn", (k * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, write


def read_ip(v):
    parts = v.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = int.from_bytes(bytes(map(int, parts)), "big")
    return "ip", n, 2**32, lambda x: ".".join(map(str, x.to_bytes(4, "big")))


#: Country codes of one and two digits; all others have three.
SHORT_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def read_phone(v):
    """North American numbers keep area and exchange at 200 or more; others keep country code and length.

    The code follows from the digits, not from how they are grouped, and North American numbers are read alike with
    their code and without, so a number has one pseudonym however it is written.
    """
    d = re.sub(r"\D", "", v)
    if not 7 <= len(d) <= 15:
        return None
    code = next((d[:n] for n in (1, 2) if d[:n] in SHORT_CODES), d[:3]) if v[0] == "+" else ""
    own = d[len(code) :]
    if len(own) < 5 or code == "1" and len(own) != 10:
        return None
    if code in ("", "1") and own[0] > "1" and own[3] > "1" and len(own) == 10:
        alphabets = ["23456789", DIGITS, DIGITS, "23456789", *[DIGITS] * 6]
    else:
        alphabets = [DIGITS[1:] if own[0] != "0" else "0", *[DIGITS] * (len(own) - 1)]
    n, size = _mixed(own, alphabets)
    return f"phone{'' if code in ('', '1') else code}{own[0] * (own[0] == '0')}{len(own)}", n, size, lambda x: _fill(v, code + _unmixed(x, alphabets))


def read_iban(v):
    d = v.replace(" ", "")
    country, check, rest = d[:2], d[2:4], d[4:]
    if not 15 <= len(d) <= 34 or _iban_check(country, rest) != check:
        return None
    alphabets = _by_class(rest)
    n, size = _mixed(rest, alphabets)

    def write(x):
        body = _unmixed(x, alphabets)
        it = iter(country + _iban_check(country, body) + body)
        return "".join(c if c == " " else next(it) for c in v)

    return f"iban{country}{re.sub('[A-Z]', 'A', re.sub('[0-9]', '9', rest))}", n, size, write


#: Days that a date of birth, of issue or of expiry can fall on; the pseudonym of such a date is another.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


def read_date(v):
    a, b, c = map(int, re.findall(r"\d+", v))
    sep = re.search(r"\D", v)[0]
    if len(re.match(r"\d+", v)[0]) == 4:
        order, y, m, d = "ymd", a, b, c
    elif sep == "/" and b > 12 or sep == "/" and a <= 12:
        order, m, d, y = "mdy", a, b, c
    else:
        order, d, m, y = "dmy", a, b, c
    try:
        day = date(y, m, d)
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    widths = [len(x) for x in re.findall(r"\d+", v)]

    def write(x):
        new = FIRST_DAY + timedelta(x)
        parts = {"y": new.year, "m": new.month, "d": new.day}
        return sep.join(str(parts[o]).zfill(w if w > 1 else 1) for o, w in zip(order, widths, strict=True))

    return "date", (day - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, write


def read_email(v):
    local, _, domain = v.rpartition("@")
    kept = "".join(c for c in local if c.isalnum())
    if not kept:
        return None
    alphabets = _by_class(kept)
    n, size = _mixed(kept, alphabets)

    def write(x):
        it = iter(_unmixed(x, alphabets))
        return "".join(next(it) if c.isalnum() else c for c in local) + "@" + domain

    return f"email{re.sub('[a-z]', 'a', re.sub('[A-Z]', 'A', re.sub('[0-9]', '9', local)))}", n, size, write


def read_secret(v):
    """A value behind a word such as password, or a key whose prefix tells it; its alphabet stays."""
    head = re.match(r"AKIA|ASIA|[A-Za-z_]+\s*[=:]\s*[\"']?", v)[0]
    body = v[len(head) :]
    if head in ("AKIA", "ASIA"):
        alphabets = [BASE32 if c in BASE32 else DIGITS for c in body]
    elif all(c in HEX for c in body):
        alphabets = [HEX] * len(body)
    else:
        alphabets = [a if c in a else c for c, a in zip(body, _by_class(body), strict=True)]
    shape = "".join(str(len(a)) + "." for a in alphabets)
    if sum(log2(len(a)) for a in alphabets) > WIDE:
        digits = [a.index(c) for c, a in zip(body, alphabets, strict=True)]
        return f"secret{shape}", digits, [len(a) for a in alphabets], lambda x: head + "".join(a[k] for k, a in zip(x, alphabets, strict=True))
    n, size = _mixed(body, alphabets)
    if size < 2:
        return None
    return f"secret{shape}", n, size, lambda x: head + _unmixed(x, alphabets)


def read_pan(v):
    alphabets = _by_class(v)
    n, size = _mixed(v, alphabets)
    return "pan", n, size, lambda x: _unmixed(x, alphabets)


CARD_RUN, GROUP = re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,}"), re.compile(r"\d+")
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
IBAN_START, IBAN_SHAPE, IBAN_RUN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?= ?[A-Z0-9])"), re.compile(IBAN), re.compile(r"(?: ?[A-Z0-9])*")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in cs.split()
}


def card_places(text):
    """(start, end) of 13 to 19 digits between group borders; by start, the longest first."""
    for run in CARD_RUN.finditer(text):
        groups = [m.span() for m in GROUP.finditer(text, *run.span())]
        for i, (a, _) in enumerate(groups):
            digits, ends = 0, []
            for x, y in groups[i : i + 19]:
                digits += y - x
                if digits > 19:
                    break
                if digits >= 13:
                    ends.append(y)
            yield from ((a, b) for b in reversed(ends))


def iban_places(text):
    """(start, end) of what is shaped like an IBAN, by start: the longest, then that of its country's length, or
    all shorter ones if the country isn't known."""
    for m in IBAN_START.finditer(text):
        a, length, ends = m.start(), 0, []
        stop = IBAN_RUN.match(text, a, a + 68).end()
        for b in range(a + 1, stop + 1):
            length += text[b - 1] != " "
            if 15 <= length <= 34 and text[b - 1] != " " and not re.match("[A-Za-z0-9]", text[b : b + 1]) and IBAN_SHAPE.fullmatch(text, a, b):
                ends.append((b, length))
        known = IBAN_LENGTHS.get(text[a : a + 2])
        yield from ((a, b) for b, n in reversed(ends) if b == ends[-1][0] or known in (None, n))


PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)")


def phone_places(text):
    """(start, end) of what is shaped like a phone number; behind a country code also what is left of it at each
    group border, the longest first."""
    for m in PHONE.finditer(text):
        yield m.span()
        if text[m.start()] == "+":
            ends = [g.end() for g in GROUP.finditer(text, *m.span())][2:-1]
            yield from ((m.start(), b) for b in reversed(ends))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    read: object
    #: Where values can lie, for kinds of which one may hide in a longer or an overlapping match.
    places: object = None


#: In the order in which they are tried at a place; the first whose value is valid wins.
KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}", read_email),
    Kind("secret", r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|secret|token|api_?key)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9_./+-]{8,})", read_secret),
    Kind("iban", rf"(?<![A-Za-z0-9]){IBAN}(?![A-Za-z0-9])", read_iban, iban_places),
    Kind("date", r"(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}([./-])\d{1,2}\1\d{4})(?![\d/-]|\.\d)", read_date),
    Kind("ip", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)", read_ip),
    Kind("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]\d|\d)", read_card, card_places),
    Kind("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]\d|\d)", read_ssn),
    Kind("aadhaar", r"(?<![\d-])\d{4}([ -]?)\d{4}\1\d{4}(?![\d-]\d|\d)", read_aadhaar),
    Kind("phone", PHONE.pattern, read_phone, phone_places),
    Kind("pan", r"(?<![A-Za-z0-9])[A-Z]{5}\d{4}[A-Z](?![A-Za-z0-9])", read_pan),
)
COMPILED = [(k, re.compile(k.pattern)) for k in KINDS]
#: Every kind has a digit in it, an @, or a word with = or : behind it.
HINT = re.compile(r"[0-9@]|[=:]\s{0,2}[\"']?\w")


class Masker:
    """One worker's view of the key."""

    def __init__(self, key: bytes, reveal: bool = False):
        self.key, self.reveal = key, reveal
        self.permutation = lru_cache(4096)(lambda tweak, size: Permutation(self.key, tweak, size))

    def replace(self, kind: Kind, value: str) -> str | None:
        got = kind.read(value)
        if got is None or not isinstance(got[2], list) and got[2] < 2:
            return None
        tweak, n, size, write = got
        p = WidePermutation(self.key, tweak, size) if isinstance(size, list) else self.permutation(tweak, size)
        return write(p.value(n) if self.reveal else p.pseudonym(n))

    def placed(self, kind: Kind, text: str, taken: list) -> list[tuple[int, int, str, str]]:
        """The first valid values of a kind with places, and their pseudonyms of equal length.

        No place that was tried in vain may become valid, or the key would find another value there. Places
        are settled one after another, and in reverse when the values are wanted back.
        """
        failed, found = [], []
        for a, b in kind.places(text):
            k = bisect_left(taken, (b,))
            if found and a < found[-1][1] or k and taken[k - 1][1] > a:
                continue
            (failed if kind.read(text[a:b]) is None else found).append((a, b))
        chars = list(text) if found else []
        for a, b in reversed(found) if self.reveal else found:
            near = [f for f in failed[bisect_left(failed, (a - 80,)) : bisect_left(failed, (b,))] if f[1] > a]
            value = text[a:b]
            while True:
                value = self.replace(kind, value)
                chars[a:b] = value
                if all(kind.read("".join(chars[x:y])) is None for x, y in near):
                    break
        return [(a, b, kind.name, "".join(chars[a:b])) for a, b in found]

    def mask(self, text: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and (start, end, kind) in code points of the original."""
        if not text or not HINT.search(text):
            return text, []
        taken: list[tuple[int, int, str, str]] = []
        for kind, pattern in COMPILED:
            if kind.name == "email" and "@" not in text:
                continue
            if kind.places:
                taken = sorted(taken + self.placed(kind, text, taken))
                continue
            found = []
            for m in pattern.finditer(text):
                k = bisect_left(taken, (m.end(),))
                if k and taken[k - 1][1] > m.start():
                    # the run of a secret may end in an address; the part before it is a secret still
                    k = bisect_left(taken, (m.start(),))
                    clear = kind.name == "secret" and not (k and taken[k - 1][1] > m.start())
                    m = pattern.match(text, m.start(), taken[k][0]) if clear else None
                    if m is None:
                        continue
                new = self.replace(kind, m[0])
                if new is not None:
                    found.append((m.start(), m.end(), kind.name, new))
            taken = sorted(taken + found)
        out, at = [], 0
        for a, b, _, new in taken:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), [(a, b, k) for a, b, k, _ in taken]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", spans: str = "pii_spans", reveal: bool = False) -> DataFrame:
    """Replaces the text column and adds the spans; reveal=True undoes it with the same key."""
    kept = [c for c in docs.columns if c != spans]
    schema = T.StructType([f for f in docs.schema.fields if f.name != spans] + [T.StructField(spans, SPANS)])

    def run(batches):
        masker = Masker(key, reveal)
        for batch in batches:
            for part in pieces(batch, text):
                found = [masker.mask(t) for t in part.column(text).to_pylist()]
                columns = [pa.array([f[0] for f in found], part.schema.field(text).type) if c == text else part.column(c) for c in kept]
                marks = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in f[1]] for f in found], ARROW_SPANS)
                yield pa.RecordBatch.from_arrays([*columns, marks], names=[*kept, spans])

    return docs.mapInArrow(run, schema)
