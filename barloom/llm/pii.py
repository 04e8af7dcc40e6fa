"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets.

Candidates are found by one pattern, validated (Luhn, mod-97, calendar, number ranges) and
then permuted, under a key, among all valid values of their own format: a card number stays a
Luhn-valid number of its length, a date stays a date in its notation, an e-mail address keeps
its domain. The permutation is a Feistel network over the format's values (two factors whose
product just covers them, walking on until a value is inside), conjugated with a step of one:
so no value is its own pseudonym, different values never meet, whoever has the key can go back
(``reveal``), and equal values stay linked across documents.

Card numbers keep their separators and permute the other digits, the check digit follows; IBANs
keep country and grouping; phone numbers keep the country code, North American ones stay possible
(area and exchange) if they were, others keep a leading zero or the lack of one; IPv4 addresses permute among
all addresses; social security numbers among the valid ones; dates among those days of 1900-2099 whose day
and month have as many digits and whose day can as well be no month, so one date has one pseudonym in
whatever notation it is written; e-mail names, passwords, tokens and access key ids keep the class of each character (its script and case).

The key is the caller's. Queries take it from the session (``session_key``): its setting
``spark.barloom.pii.secret``, which Spark redacts in its logs, or a random one made for the session, so that
nobody can go back and values are linked within it only.

Defined cases: a null text stays null and has nothing found; a text without candidates is
unchanged; candidates that fail validation are left alone, and what begins inside them is looked at;
digits are 0 to 9 alone, numbers in other scripts' digits are no candidates; equal texts give equal results;
whole texts of any length are read once; an empty table gives an empty result; other columns
are kept by ``pseudonymised``, and one named like its column of finds (a parameter) is replaced.
"""

from __future__ import annotations

import calendar
import datetime as dt
import hashlib
import math
import re
import secrets
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.util import fields

#: The session's setting with the secret key.
SECRET = "spark.barloom.pii.secret"
ROUNDS = 10
YEARS = 1900, 2099
SSN_AREAS = [area for area in range(1, 900) if area != 666]
#: Characters that stand for one another in e-mail names, IBANs and secrets.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
HEX = "0123456789abcdef"
#: Longer secrets are permuted in parts of so many characters, which the network's numbers cover.
PART = 128
#: Pseudonyms that are tried where a failed candidate reaches into a valid one.
TURNS = 1000
CLASS_OF = {char: chars for chars in CLASSES for char in chars}


@lru_cache(maxsize=1 << 16)
def class_of(char: str) -> str:
    """The characters that may stand for one: for letters of other scripts those of its case among its 64 neighbours in Unicode."""
    if char in CLASS_OF or not char.isalpha():
        return CLASS_OF.get(char, char)
    kind, first = unicodedata.category(char), ord(char) & ~63
    return "".join(chr(point) for point in range(first, first + 64) if unicodedata.category(chr(point)) == kind and chr(point) not in CLASS_OF)



#: Country codes of telephone numbers by their length (ITU-T E.164); all others have three digits.
DIAL_CODES = {
    1: "1 7",
    2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98",
}
DIAL_LENGTHS = {code: length for length, codes in DIAL_CODES.items() for code in codes.split()}

#: Countries by the length of their IBANs (the SWIFT registry).
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO EG GT HN HU LB NI PL SV", 29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """IBANs as long as their country's are, in one run or in groups of four; those of other countries up to the last group."""
    part, known = "[ ]?[A-Z0-9]", "|".join(" ".join(IBAN_COUNTRIES.values()).split())
    kinds = [
        f"(?:{'|'.join(names.split())})[0-9][0-9](?:{part}{{4}}){{{length // 4 - 1}}}" + (f"{part}{{{length % 4}}}" if length % 4 else "")
        for length, names in IBAN_COUNTRIES.items()
    ]
    return "|".join([*kinds, f"(?!{known})[A-Z]{{2}}[0-9][0-9](?:{part}{{4}}){{2,7}}(?:{part}{{1,3}})?"])


PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.+%-])[\w.+%-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w@]))
  | (?P<secret>(?<![^\W_])(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)(?:[_-](?:access[_-]?)?key)?)["']?\s{0,3}[=:]\s{0,3}
      (?:"(?:(?!")[!-~À-ÿ]){7,}(?![".,;:!?])[!-~À-ÿ]|'(?:(?!')[!-~À-ÿ]){7,}(?!['.,;:!?])[!-~À-ÿ]|["']?[A-Za-z0-9À-ÿ!\#$%*+./:=?@^_~-]{7,}[A-Za-z0-9À-ÿ\#$%*+/=@^_~-]))
  | (?P<access_key>(?<!\w)A(?:KIA|SIA)[0-9A-Z]{16}(?!\w))
  | (?P<iban>(?<!\w)(?=[A-Z]{2}[0-9][0-9])(?:"""
    + _iban_pattern()
    + r""")(?!\w))
  | (?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))
  | (?P<date>(?<![\w/.-])(?:[0-9]{4}(?P<mark>[-/.])[0-9]{2}(?P=mark)[0-9]{2}|[0-9]{1,2}(?P<sign>[-/.])[0-9]{1,2}(?P=sign)[0-9]{4})(?!(?!T[0-9][0-9])\w|[/-]|\.[0-9]))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
  | (?P<phone>(?<![\w+])(?:(?:\+1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]\(?[0-9]{2,4}\)?){2,4}|\+[0-9]{8,15})(?!\w|-[0-9]))
  | (?P<card>(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}|[0-9]{4}(?P<slot>[ -])[0-9]{6}(?P=slot)[0-9]{5})(?!\w))
    """,
    re.VERBOSE,
)
#: Every candidate holds one of these.
HINT = re.compile(r"[0-9@]|A[KS]IA|(?i:passw|pwd|secret|token|api)")

FOUND = fields(text="string", found=T.ArrayType(fields(kind="string", start="long", end="long")))


class Permuter:
    """Keyed permutations of 0 .. size - 1; forward with ``step`` 1, back with -1."""

    def __init__(self, key: bytes, step: int = 1):
        self.key, self.step = hashlib.blake2b(key).digest(), step

    def _share(self, kind: str, size: int, turn: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}|{size}|{turn}|{half}".encode(), key=self.key).digest(), "big")

    def _feistel(self, value: int, size: int, kind: str, turns: range, sign: int) -> int:
        rows = math.isqrt(size - 1) + 1
        columns = -(-size // rows)
        while True:
            left, right = divmod(value, columns)
            for turn in turns:
                if turn % 2:
                    right = (right + sign * self._share(kind, size, turn, left)) % columns
                else:
                    left = (left + sign * self._share(kind, size, turn, right)) % rows
            value = left * columns + right
            if value < size:
                return value

    def __call__(self, value: int, size: int, kind: str) -> int:
        if size < 2:
            return value
        inside = self._feistel(value, size, kind, range(ROUNDS), 1)
        return self._feistel((inside + self.step) % size, size, kind, range(ROUNDS)[::-1], -1)

    def number(self, digits: str, kind: str) -> str:
        """A string of digits, leading zeros allowed."""
        return str(self(int(digits), 10 ** len(digits), kind)).zfill(len(digits)) if digits else digits

    def characters(self, text: str, kind: str, alphabet: str | None = None) -> str:
        """A text whose characters move within their class (or within ``alphabet``); others stay."""
        classes = [(alphabet if alphabet and char in alphabet else class_of(char)) for char in text]
        value, size = 0, math.prod(map(len, classes))
        for char, chars in zip(text, classes, strict=True):
            value = value * len(chars) + chars.index(char)
        value, out = self(value, size, f"{kind}|{'|'.join(chars[0] for chars in classes)}"), []
        for chars in reversed(classes):
            value, at = divmod(value, len(chars))
            out.append(chars[at])
        return "".join(reversed(out))


def _refilled(form: str, digits: str) -> str:
    """``form`` with its digits, or letters and digits where ``digits`` has as many, replaced in order."""
    left = iter(digits)
    return "".join(next(left) if char.isalnum() else char for char in form)


def luhn_digit(digits: str) -> str:
    """The check digit that belongs behind ``digits``."""
    doubled = (2 * int(digit) if k % 2 == 0 else int(digit) for k, digit in enumerate(reversed(digits)))
    return str(-sum(value - 9 if value > 9 else value for value in doubled) % 10)


def _card(text: str, permute: Permuter) -> str | None:
    digits = re.sub(r"[^0-9]", "", text)
    body = digits[:-1]
    if digits[0] == "0" or luhn_digit(body) != digits[-1]:
        return None
    least = 10 ** (len(body) - 1)
    body = str(permute(int(body) - least, 9 * least, "card") + least)
    return _refilled(text, body + luhn_digit(body))


def _mod97(text: str) -> int:
    return int("".join(str(int(char, 36)) for char in text)) % 97


def _iban(text: str, permute: Permuter) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = permute.characters(plain[4:], "iban")
    return _refilled(text, f"{plain[:2]}{98 - _mod97(body + plain[:2] + '00'):02d}{body}")


def _ip(text: str, permute: Permuter) -> str | None:
    parts = text.split(".")
    if any(len(part) > 1 and part[0] == "0" or int(part) > 255 for part in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _read_date(text: str) -> tuple[str, str, dt.date] | None:
    """(mark, order, day): how a date is written and its day, if it is one; with slashes the month comes first where it can."""
    mark = re.search(r"[^0-9]", text)[0]
    parts = text.split(mark)
    orders = ["ymd"] if len(parts[0]) == 4 else (["mdy", "dmy"] if mark == "/" else ["dmy"])
    for order in orders:
        value = dict(zip(order, map(int, parts), strict=True))
        try:
            day = dt.date(value["y"], value["m"], value["d"])
        except ValueError:
            continue
        return (mark, order, day) if YEARS[0] <= day.year <= YEARS[1] else None
    return None


def _day_kind(day: int, month: int) -> str:
    """What a date's notation may depend on: digits of day and month, and whether the day could be a month."""
    return f"{(day > 9) + (day > 12)}{month > 9:d}"


@lru_cache(maxsize=1)
def _days() -> dict[str, list[tuple[int, int]]]:
    """The days of a year of each kind, as (month, day); those of a leap year by themselves."""
    year = [dt.date(2000, 1, 1) + dt.timedelta(days=k) for k in range(366)]
    kinds: dict[str, list[tuple[int, int]]] = {}
    for date in year:
        kinds.setdefault(_day_kind(date.day, date.month), []).append((date.month, date.day))
    return kinds


def _date(text: str, permute: Permuter) -> str | None:
    found = _read_date(text)
    if found is None:
        return None
    mark, order, date = found
    kind = _day_kind(date.day, date.month)
    days = _days()[kind]
    value = (date.year - YEARS[0]) * len(days) + days.index((date.month, date.day))
    while True:  # on from a 29th of February that isn't
        value = permute(value, (YEARS[1] - YEARS[0] + 1) * len(days), f"date {kind}")
        year, (month, day) = YEARS[0] + value // len(days), days[value % len(days)]
        if (month, day) != (2, 29) or calendar.isleap(year):
            break
    new = {"y": year, "m": month, "d": day}
    return mark.join(str(new[name]).zfill(len(part)) for name, part in zip(order, text.split(mark), strict=True))


def _ssn(text: str, permute: Permuter) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area not in SSN_AREAS or not group or not serial:
        return None
    value = permute((SSN_AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1, len(SSN_AREAS) * 99 * 9999, "ssn")
    rest, serial = divmod(value, 9999)
    area, group = divmod(rest, 99)
    return f"{SSN_AREAS[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


#: Area codes and exchanges that North American numbers can have, and the others.
POSSIBLE = [n for n in range(200, 1000) if n % 100 != 11]
POSSIBLE_SET = {*POSSIBLE}
IMPOSSIBLE = sorted({*range(1000)} - POSSIBLE_SET)


def _north_american(digits: str, permute: Permuter) -> str:
    """Ten digits: area and exchange move among those that are possible, or among those that aren't."""
    parts = [int(digits[:3]), int(digits[3:6])]
    choices = [POSSIBLE if part in POSSIBLE_SET else IMPOSSIBLE for part in parts]
    value, size = 0, 10_000 * math.prod(map(len, choices))
    for part, choice in zip(parts, choices, strict=True):
        value = value * len(choice) + bisect_left(choice, part)
    value = permute(value * 10_000 + int(digits[6:]), size, f"phone {len(choices[0])} {len(choices[1])}")
    rest, line = divmod(value, 10_000)
    area, exchange = divmod(rest, len(choices[1]))
    return f"{choices[0][area]:03d}{choices[1][exchange]:03d}{line:04d}"


def _phone(text: str, permute: Permuter) -> str | None:
    digits = re.sub(r"[^0-9]", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    code = digits[: next((n for n in (1, 2) if DIAL_LENGTHS.get(digits[:n]) == n), 3)] if text[0] == "+" else ""
    own = digits[len(code) :]
    if len(own) == 10 and code in ("", "1"):
        new = _north_american(own, permute)
    elif own[0] == "0":
        new = permute.number(own[1:], f"phone {code} 0").rjust(len(own), "0")
    else:
        least = 10 ** (len(own) - 1)
        new = str(permute(int(own) - least, 9 * least, f"phone {code}") + least)
    return _refilled(text, code + new)


def _email(text: str, permute: Permuter) -> str | None:
    name, _, domain = text.rpartition("@")
    return f"{permute.characters(name, 'email')}@{domain}"


def _secret(text: str, permute: Permuter) -> str | None:
    at = re.search(r"[=:]\s*[\"']?", text).end()
    value = text[at:]
    alphabet = HEX if all(char in HEX for char in value) else None
    kind = "hex" if alphabet else "secret"
    parts = [permute.characters(value[k : k + PART], f"{kind}{k or ''}", alphabet) for k in range(0, len(value), PART)]
    new = text[:at] + "".join(parts)
    return new if new != text else None


def _access_key(text: str, permute: Permuter) -> str | None:
    return text[:4] + permute.characters(text[4:], "access key", CLASSES[2] + CLASSES[0])


KINDS: dict[str, Callable[[str, Permuter], str | None]] = {
    "email": _email, "secret": _secret, "access_key": _access_key, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card,
}


def _next(text: str, at: int, permute: Permuter) -> tuple[re.Match, str, str, int] | None:
    """The first valid candidate from ``at`` on, its kind and pseudonym, and the start of the first failed one that reaches into it (or its own)."""
    failed: list[tuple[int, int]] = []
    while match := PATTERN.search(text, at):
        kind = next(name for name in KINDS if match[name] is not None)
        new = KINDS[kind](match[0], permute)
        if new is not None:
            return match, kind, new, min([start for start, end in failed if end > match.start()], default=match.start())
        failed = [*(x for x in failed if x[1] > match.start()), match.span()]
        at = match.start() + 1
    return None


def _settled(text: str, match: re.Match, kind: str, new: str, first: int, permute: Permuter) -> str:
    """The pseudonym, or one further on, that leaves the failed candidates that reach into it failed, so that the way back finds it."""
    before, behind = text[max(0, first - 1) : match.start()], text[match.end() : match.end() + 64]
    for _ in range(TURNS):
        found = _next(before + new + behind, min(first, 1), permute)
        if found and found[0].span() == (len(before), len(before) + len(new)):
            return new
        new = KINDS[kind](new, permute)
    return new


def replace(text: str | None, permute: Permuter) -> tuple[str | None, list[tuple[str, int, int]]]:
    """A text with pseudonyms, and their kinds and places in it."""
    if not text or not HINT.search(text):
        return text, []
    out, found, done, length = [], [], 0, 0
    while hit := _next(text, done, permute):
        match, kind, new, first = hit
        if first < match.start():
            new = _settled(text, match, kind, new, first, permute)
        before = text[done : match.start()]
        found.append((kind, length + len(before), length + len(before) + len(new)))
        out += [before, new]
        length, done = found[-1][2], match.end()
    return "".join([*out, text[done:]]), found


def session_key(spark: SparkSession) -> bytes:
    """The secret that the session is set to; where there is none, a random one is made and kept in it."""
    secret = spark.conf.get(SECRET, None)
    if not secret:
        secret = secrets.token_hex(32)
        spark.conf.set(SECRET, secret)
    return secret.encode()


def pseudonyms(text: str | Column, key: bytes, step: int = 1) -> Column:
    """A struct column (text, found) of each text."""

    @F.pandas_udf(FOUND)
    def replaced(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        permute = Permuter(key, step)
        for batch in texts:
            rows = [replace(value, permute) for value in batch]
            made = [[{"kind": kind, "start": start, "end": end} for kind, start, end in found] for _, found in rows]
            yield pd.DataFrame({"text": pd.Series([value for value, _ in rows], dtype=object), "found": pd.Series(made, dtype=object)})

    return replaced(F.col(text) if isinstance(text, str) else text)


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", found: str = "pii_found", step: int = 1) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and their kinds and places in the column ``found``."""
    made = docs.select(*[F.col(f"`{name}`") for name in docs.columns if name not in (text, found)], pseudonyms(text, key, step).alias(found))
    order = [F.col(f"`{found}`.text").alias(text) if name == text else F.col(f"`{name}`") for name in docs.columns if name != found]
    return made.select(*order, F.col(f"`{found}`.found").alias(found))


def reveal(docs: DataFrame, key: bytes, text: str = "text", found: str = "pii_found") -> DataFrame:
    """The way back from ``pseudonymised``, for whoever has the key."""
    return pseudonymised(docs, key, text, found, -1)


def counted(found: Column) -> Column:
    """Kinds and how often each was found, as text: ``card=1,email=2``."""
    number = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), number(kind).alias("n")) for kind in sorted(KINDS)])
    shown = F.transform(F.filter(kinds, lambda x: x["n"] > 0), lambda x: F.concat_ws("=", x["kind"], x["n"].cast("string")))
    return F.array_join(shown, ",")

