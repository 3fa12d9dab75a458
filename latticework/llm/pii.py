"""Format-preserving pseudonyms of personal data by a keyed Feistel permutation.

Found: e-mail addresses (name and domain, all but the last label), telephone numbers (North American ones with separators or of ten digits, international
ones behind a plus), card numbers (Luhn), IBANs (mod 97), social security numbers (valid
ranges; without hyphens behind "SSN" or "social security"), IPv4 and IPv6 addresses, calendar dates (in figures, or with the month's name, which stays) and credentials (access key ids, known
beginnings of tokens, what stands behind "Bearer", and values assigned to names with password, token, secret, api key or access key, up to white space or
a quote). Values of any length are replaced whole. A value is read as a number below the count of values of its format (mixed radix: a digit for a digit, a
letter for a letter of the same case, a day for a day), which a Feistel network over two halves permutes:
ten rounds of modular addition of a keyed hash of the other half, walking on while the result is out of range. The
pseudonym of x is P^-1(P(x) + 1), which no value has for itself. Check digits are made anew, so validated
numbers stay valid. The hash depends on the key, the kind and the format only, so equal values
get equal pseudonyms in all documents, whatever their separators; a telephone number's last ten digits link with and
without its country; each label of a domain links; a date keeps its day across notations of two-digit days and months (with a digit for day or month it
links within its notation, as does an IPv6 address). Digits are ASCII digits.

Defined cases: a null text stays null and has no span; empty texts, texts without a value and values that fail
validation stay as they are; overlapping candidates go to the earlier, then the longer; repeated rows give repeated
rows; null ids are kept; an empty table gives an empty result; very long texts are searched whole; other columns pass through with
``keep``, whatever their names. Text lengths never change.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import kept

ROUNDS = 10
LONGEST = 128  # characters that one permutation takes; longer values take several
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Permutation:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, key: bytes, label: str, n: int):
        self.n = n
        self.a = max(1, isqrt(n - 1) + 1)
        self.b = -(-n // self.a)
        self.base = hashlib.blake2b(f"{label}|{n}".encode(), key=key[:64], digest_size=32).digest()
        self.width = (max(self.a, self.b).bit_length() + 7) // 8

    def _f(self, r: int, half: int, size: int) -> int:
        h = hashlib.blake2b(r.to_bytes(1, "little") + half.to_bytes(self.width, "little"), key=self.base, digest_size=min(64, self.width + 16))
        return int.from_bytes(h.digest(), "little") % size

    def _rounds(self, x: int, sign: int) -> int:
        left, right = divmod(x, self.b)  # left below a, right below b
        for r in range(ROUNDS) if sign > 0 else reversed(range(ROUNDS)):
            if r % 2:
                right = (right + sign * self._f(r, left, self.b)) % self.b
            else:
                left = (left + sign * self._f(r, right, self.a)) % self.a
        return left * self.b + right

    def forth(self, x: int) -> int:
        x = self._rounds(x, 1)
        while x >= self.n:
            x = self._rounds(x, 1)
        return x

    def back(self, x: int) -> int:
        x = self._rounds(x, -1)
        while x >= self.n:
            x = self._rounds(x, -1)
        return x

    def pseudonym(self, x: int) -> int:
        return self.back((self.forth(x) + 1) % self.n) if self.n > 1 else x

    def value(self, y: int) -> int:
        """The value whose pseudonym is y."""
        return self.back((self.forth(y) - 1) % self.n) if self.n > 1 else y


def to_number(digits: list[int], radix: list[int]) -> int:
    x = 0
    for d, r in zip(digits, radix):
        x = x * r + d
    return x


def to_digits(x: int, radix: list[int]) -> list[int]:
    out = []
    for r in reversed(radix):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def luhn_digit(digits: str) -> str:
    """The check digit that completes ``digits``."""
    total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_check(country: str, bban: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in bban + country) + '00') % 97:02d}"


def refill(template: str, chars: str) -> str:
    """``chars`` in the places of the template's letters and digits, in the template's case."""
    it = iter(chars)
    return "".join((n.upper() if c.isupper() else n.lower()) if c.isalnum() and (n := next(it)) else c for c in template)


class Pseudonyms:
    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key = key
        self._known: dict[tuple[str, int], Permutation] = {}

    def permutation(self, label: str, n: int) -> Permutation:
        if (label, n) not in self._known:
            if len(self._known) > 10_000:
                self._known.clear()
            self._known[label, n] = Permutation(self.key, label, n)
        return self._known[label, n]

    def mixed(self, kind: str, digits: list[int], radix: list[int]) -> list[int]:
        label = kind + ":" + ",".join(map(str, radix))
        return to_digits(self.permutation(label, prod(radix)).pseudonym(to_number(digits, radix)), radix)

    def characters(self, kind: str, value: str, hexadecimal: bool = False) -> str:
        """A letter for a letter, a digit for a digit; the rest and non-ASCII letters stay."""
        flat = "".join(c for c in value if c.isascii() and c.isalnum()).lower()
        out, label = "", kind
        for at in range(0, len(flat), LONGEST):  # what comes after is permuted as what comes before asks for, so the whole is one to one
            part = flat[at : at + LONGEST]
            if hexadecimal:
                out += "".join(f"{d:x}" for d in self.mixed(label, [int(c, 16) for c in part], [16] * len(part)))
            else:
                base = [10 if c.isdigit() else 26 for c in part]
                got = self.mixed(label, [int(c) if c.isdigit() else ord(c) - 97 for c in part], base)
                out += "".join(str(d) if r == 10 else chr(97 + d) for d, r in zip(got, base))
            label = f"{kind}|{hashlib.blake2b(flat[: at + LONGEST].encode(), key=self.key[:64], digest_size=16).hexdigest()}"
        if hexadecimal:
            return out if value == value.lower() else out.upper()
        it = iter(out)
        return "".join((n.upper() if c.isupper() else n) if c.isascii() and c.isalnum() and (n := next(it)) else c for c in value)

    # one function a kind: the match's replacement, or None where it isn't valid

    def email(self, m: re.Match) -> str | None:
        *labels, top = m["domain"].split(".")
        return self.characters("email", m["local"]) + "@" + ".".join([*(self.characters("domain", x) for x in labels), top])

    def phone(self, m: re.Match) -> str | None:
        text = m.group()
        digits = [int(c) for c in text if c.isdigit()]
        if text[0] == "+" and not 8 <= len(digits) <= 15:
            return None
        own = min(10, len(digits) - 1) if text[0] in "+0" else 10  # what is before is the country, or the zero of national numbers
        return refill(text, "".join(map(str, digits[:-own] + self.mixed("phone", digits[-own:], [10] * own))))

    def card(self, m: re.Match) -> str | None:
        flat = re.sub("[^0-9]", "", m.group())
        if not 13 <= len(flat) <= 19 or luhn_digit(flat[:-1]) != flat[-1] or len(set(flat)) == 1:
            return None
        body = "".join(map(str, self.mixed("card", [int(c) for c in flat[:-1]], [10] * (len(flat) - 1))))
        return refill(m.group(), body + luhn_digit(body))

    def iban(self, m: re.Match) -> str | None:
        """For the match or, where words that follow are in it, its beginning up to a space: the end that the country's length
        asks for, else the last one with a valid check."""
        text = m.group()
        ends = [len(text), *[k for k in range(len(text) - 1, 0, -1) if text[k] == " "]]
        for end in sorted(ends, key=lambda k: k - text.count(" ", 0, k) != IBAN_LENGTH.get(text[:2].upper())):
            flat = text[:end].replace(" ", "")
            country, check, bban = flat[:2].upper(), flat[2:4], flat[4:]
            if flat != flat.upper() and len(flat) != IBAN_LENGTH.get(country):
                continue  # small letters are words more often
            if 11 <= len(bban) <= 30 and iban_check(country, bban) == check:
                bban = self.characters("iban" + country, bban)
                return refill(text[:end], country + iban_check(country, bban) + bban)
        return None

    def ssn(self, m: re.Match) -> str | None:
        number = m["ssn"] or m["plain"]
        area, group, serial = int(number.replace("-", "")[:3]), int(number.replace("-", "")[3:5]), int(number[-4:])
        areas = 898  # 001 to 899 without 666
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        a, g, s = self.mixed("ssn", [area - 1 - (area > 666), group - 1, serial - 1], [areas, 99, 9999])
        made = f"{a + 1 + (a + 1 >= 666):03d}{g + 1:02d}{s + 1:04d}"
        return m.group()[: -len(number)] + refill(number, made)

    def ip6(self, m: re.Match) -> str | None:
        text = m.group()
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return None
        flat = text.replace(":", "")
        if len(flat) < 5 or not any(c.isdigit() for c in flat):
            return None
        made = self.mixed("ip6:" + "".join(":" if c == ":" else "x" for c in text), [int(c, 16) for c in flat], [16] * len(flat))
        it = iter(f"{d:x}" for d in made)
        out = "".join(c if c == ":" else next(it) for c in text)
        return out.upper() if text == text.upper() else out

    def ip(self, m: re.Match) -> str | None:
        octets = m.group().split(".")
        if any(int(o) > 255 or len(o) > 1 and o[0] == "0" for o in octets):
            return None
        low = [(0, 10, 100)[len(o) - 1] for o in octets]
        radix = [(10, 90, 156)[len(o) - 1] for o in octets]
        return ".".join(str(d + b) for d, b in zip(self.mixed("ip", [int(o) - b for o, b in zip(octets, low)], radix), low))

    def date(self, m: re.Match) -> str | None:
        a, sep, b, sep2, c = m.groups()[-5:]
        if sep != sep2:
            return None
        year_first = len(a) == 4
        if len(b) == 1 or len(a) == 1:
            return self._short_date(a, sep, b, c)
        y, x, z = (int(a), int(b), int(c)) if year_first else (int(c), int(b), int(a))
        swap = not year_first and x > 12  # month first only where day first is no date
        month, day = (z, x) if swap else (x, z)
        k = _day(y, month, day)
        if k is None:
            return None
        d = datetime.date.fromordinal(self.permutation("date", DAYS).pseudonym(k) + FIRST_DAY)
        if year_first:
            return f"{d.year:04d}{sep}{d.month:02d}{sep}{d.day:02d}"
        return f"{d.month:02d}{sep}{d.day:02d}{sep}{d.year:04d}" if swap else f"{d.day:02d}{sep}{d.month:02d}{sep}{d.year:04d}"

    def _short_date(self, a: str, sep: str, b: str, year: str) -> str | None:
        """A date whose day or month has one digit: another of the same widths, day first or month first."""
        low = [(1, 9), (10, 22)]  # the first number of a width and how many there are: 1 to 9, 10 to 31
        (a0, an), (b0, bn) = low[len(a) - 1], low[len(b) - 1]
        x, y, z = int(a), int(b), int(year)

        def valid(x: int, y: int, z: int) -> bool:
            return _day(z, y, x) is not None or _day(z, x, y) is not None

        if not valid(x, y, z):
            return None
        while True:  # walking on to the next date keeps it a permutation of the dates
            i, j, k = self.mixed("date", [x - a0, y - b0, z - 1900], [an, bn, 200])
            x, y, z = i + a0, j + b0, k + 1900
            if valid(x, y, z):
                return f"{x}{sep}{y}{sep}{z:04d}"

    def date_short_year(self, m: re.Match) -> str | None:
        """A date whose year has two digits, of which 00 to 68 are this century's: another of the same widths."""
        a, b, c = m["x"], m["y"], m["z"]
        century = lambda z: 2000 + z if z < 69 else 1900 + z
        valid = lambda x, y, z: _day(century(z), y, x) is not None or _day(century(z), x, y) is not None
        x, y, z = int(a), int(b), int(c)
        low = {1: (1, 9), 2: (1, 31)}
        (a0, an), (b0, bn) = low[len(a)], low[len(b)]
        if not valid(x, y, z) or x < a0 or y < b0:
            return None
        while True:
            i, j, z = self.mixed("date_short_year", [x - a0, y - b0, z], [an, bn, 100])
            x, y = i + a0, j + b0
            if valid(x, y, z):
                return f"{x:0{len(a)}d}/{y:0{len(b)}d}/{z:02d}"

    def date_named(self, m: re.Match) -> str | None:
        """A date with its month's name: another day and year of that month, with as many digits."""
        month = MONTHS.index(m["month"][:3].lower()) + 1
        which = "day" if m["day"] else "day2"
        width, day, year = len(m[which]), int(m[which]), int(m["year"])
        first, many = ((1, 9), (1, 31))[width - 1]
        if _day(year, month, day) is None or day < first:
            return None
        while True:
            d, z = self.mixed(f"date_named{month}", [day - first, year - 1900], [many, 200])
            day, year = d + first, z + 1900
            if _day(year, month, day) is not None:
                text, at = m.group(), m.start()
                places = sorted([(m.start(which) - at, m.end(which) - at, f"{day:0{width}d}"), (m.start("year") - at, m.end("year") - at, f"{year:04d}")])
                (a, b, one), (c, e, two) = places
                return text[:a] + one + text[b:c] + two + text[e:]

    def key_id(self, m: re.Match) -> str | None:
        return m.group()[:4] + self.characters("key", m.group()[4:])

    def token(self, m: re.Match) -> str | None:
        """A credential known by its beginning, which stays."""
        at = m.start("value") - m.start()
        return m.group()[:at] + self.characters("secret", m["value"])

    def secret(self, m: re.Match) -> str | None:
        value = m["value"].rstrip(".,;:!?)]}>")
        if len(value) < 6 or len(value) < 8 and value.isalpha():
            return None  # a word
        at = m.start("value") - m.start()
        plain = self.characters("secret", value, hexadecimal=re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None)
        return m.group()[:at] + plain + m.group()[at + len(value) :]


MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

# fixed values: characters of an IBAN by country
_LENGTHS = (
    "15 NO 16 BE 18 DK FI FK FO GL NL SD 19 MK SI 20 AT BA EE KZ LT LU MN XK 21 CH HR LI LV 22 BG BH CR DE GB GE IE ME RS VA 23 AE GI IL IQ OM SO TL "
    "24 AD CZ ES MD PK RO SA SE SK TN VG 25 LY PT ST 26 IS TR 27 BI DJ FR GR IT MC MR SM 28 AL AZ BY CY DO GT HU LB NI PL SV 29 BR EG PS QA UA 30 JO KW MU YE 31 MT SC 32 LC 33 RU"
)
IBAN_LENGTH: dict[str, int] = {}
for _w in _LENGTHS.split():
    if _w.isdigit():
        _n = int(_w)
    else:
        IBAN_LENGTH[_w] = _n

def _day(year: int, month: int, day: int) -> int | None:
    try:
        k = datetime.date(year, month, day).toordinal() - FIRST_DAY
    except ValueError:
        return None
    return k if 0 <= k < DAYS else None


# fixed values: the patterns of the kinds, in the order in which ties are broken
KINDS: list[tuple[str, str]] = [
    ("secret", r"(?<![A-Za-z])(?i:(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)(?:[_-][A-Za-z0-9_-]+|s)?)[\"']?[ \t]*[=:][ \t]*[\"']?(?P<value>[^\s\"'`]{6,})"),
    ("key_id", r"(?<![A-Za-z0-9])(?i:AKIA|ASIA)[A-Za-z0-9]{16}(?![A-Za-z0-9])"),
    ("token", r"(?<![A-Za-z0-9_-])(?:(?i:bearer)[ \t]+(?=[^\s\"']*[0-9])|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k[_-](?:live[_-]|test[_-])?(?=[A-Za-z0-9_-]*[0-9])|eyJ(?=[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+))(?P<value>[A-Za-z0-9._~+/-]{16,})"),
    ("email", r"(?<![\w.+%\-])(?P<local>[\w.+%\-]+)@(?P<domain>(?:[\w\-]+\.)+[^\W\d_]{2,})(?![\w\-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("phone", r"(?<![\w+])(?:(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![\w\-])|\+[0-9](?:[ .\-]?[0-9]|[ .\-]?\([0-9]{1,4}\)){7,14}(?![\w\-]|[ .\-]?[0-9])|(?<![.\-])[2-9][0-9]{2}[2-9][0-9]{6}(?![\w\-]|\.[0-9])|(?<![.\-])0[0-9]{2,4}[ \-][0-9]{3,4}[ \-][0-9]{3,4}(?![\w\-]|[ .\-]?[0-9]))"),
    ("ssn", r"(?<![\w\-])(?:(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})|(?i:SSN|social security(?: number| no\.?)?)[ \t]{0,3}[:#=]?[ \t]{0,3}(?P<plain>[0-9]{9}))(?![\w\-])"),
    ("card", r"(?<![\w.\-])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){2,3}(?:[ \-][0-9]{1,3})?|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![\w\-])"),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])"),
    ("ip6", r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4}(?![\w:]|\.[0-9])|(?<![\w:.])[0-9A-Fa-f]{4}::[0-9A-Fa-f]{1,4}(?![\w:]|\.[0-9])"),
    ("date", r"(?<![\w.\-/])(?:([0-9]{4})([\-/.])([0-9]{2})([\-/.])([0-9]{2})|(?P<d>[0-9]{1,2})(?P<s>[\-/.])(?P<m>[0-9]{1,2})(?P<t>[\-/.])(?P<y>[0-9]{4}))(?:(?=[Tt][0-9]{2})|(?![\w\-/]|\.[0-9]))"),
    ("date_short_year", r"(?<![\w.\-/])(?P<x>[0-9]{1,2})/(?P<y>[0-9]{1,2})/(?P<z>[0-9]{2})(?![\w\-/]|\.[0-9])"),
    ("date_named", r"(?<![\w.\-/])(?:(?P<day>[0-9]{1,2})(?:st|nd|rd|th)? )?(?P<month>(?i:january|february|march|april|may|june|july|august|september|october|november|december|(?:jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)\b\.?))(?(day)| (?P<day2>[0-9]{1,2})(?:st|nd|rd|th)?),? (?P<year>[0-9]{4})(?![\w\-/])"),
]
_PATTERNS = [(k, re.compile(p)) for k, p in KINDS]
_DIGIT = re.compile("[0-9]")
_SIGN = re.compile(r"[0-9@=:]|(?i:AKIA|ASIA)|eyJ|gh[pousr]_|glpat-|xox[abprs]-")


def pseudonymise(text: str, p: Pseudonyms) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms and the spans (start, end, kind) that were replaced."""
    if not text or not _SIGN.search(text):
        return text, []
    found: list[tuple[int, int, int, str]] = []
    digits = _DIGIT.search(text) is not None
    for k, (kind, pattern) in enumerate(_PATTERNS):
        if (kind == "email" and "@" not in text) or (kind == "ip6" and ":" not in text) or (kind not in ("email", "secret", "key_id", "token") and not digits):
            continue
        make: Callable = getattr(p, kind)
        if kind == "iban":
            found += [(m.start(), -m.start() - len(new), k, new) for m, new in _shortening(pattern, text, make)]
            continue
        for m in pattern.finditer(text):
            if kind == "date":
                m = _Date(m)
            if (new := make(m)) is not None and len(new) == m.end() - m.start():
                found.append((m.start(), -m.end(), k, new))
    if not found:
        return text, []
    out, spans, at = [], [], 0
    for start, end, k, new in sorted(found):
        if start < at:
            continue
        out += [text[at:start], new]
        at = -end
        spans.append((start, at, "date" if KINDS[k][0].startswith("date") else KINDS[k][0]))
    return "".join([*out, text[at:]]), spans


def _shortening(pattern: re.Pattern, text: str, make: Callable):
    """Matches and replacements where a value may end before the match does: the search goes on where the value ends, or within a match
    without a value."""
    at = 0
    while (m := pattern.search(text, at)) is not None:
        new = make(m)
        if new is not None:
            yield m, new
        at = m.start() + (1 if new is None else len(new))


class _Date:
    """A date match with its five parts, whichever notation it is in."""

    def __init__(self, m: re.Match):
        self.start, self.end, self.group = m.start, m.end, m.group
        self.parts = m.groups()[:5] if m.group(1) else m.groups()[5:]

    def groups(self):
        return self.parts


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per document: id, text with pseudonyms, spans (array of start, end, kind in characters of the text) and n_found.

    With ``keep`` the other columns of ``docs`` come too (those named spans or n_found make way).
    """
    rest = [c for c in docs.columns if c not in ("spans", "n_found", text_col)] if keep else [id_col]
    # the caller's columns travel in one, so none of their names can clash
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), F.col(text_col).cast("string").alias("text"))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([given.schema["doc"], T.StructField("text", T.StringType()), T.StructField("spans", spans_type)])

    def run(batches):
        p = kept(("pii", key), lambda: Pseudonyms(key))
        for batch in batches:
            texts = batch.column(1)
            done = [(None, []) if t is None else pseudonymise(t, p) for at in range(0, batch.num_rows, 256) for t in texts.slice(at, 256).to_pylist()]
            texts = pa.array([t for t, _ in done], pa.string())
            spans = pa.array([[dict(zip(("start", "end", "kind"), s)) for s in found] for _, found in done], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, spans], names=["doc", "text", "spans"])

    done = given.mapInArrow(run, schema)
    return done.select(*[F.col("doc").getField(c).alias(c) for c in rest], F.col("text").alias(text_col), "spans", F.size("spans").alias("n_found"))
