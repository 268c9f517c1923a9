"""Format-preserving pseudonyms: validated numbers and dates are permuted within their format by a keyed Feistel network."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches

ROUNDS = 8
_DIGITS = "0123456789"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_HEX = "0123456789abcdef"
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of 0 .. size - 1: an alternating Feistel network on the product of two near equal moduli, walked until it lands inside."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.left = math.isqrt(size - 1) + 1 if size > 1 else 1
        self.right = -(-size // self.left)
        self.key = hashlib.blake2b(f"{tweak}/{size}".encode(), key=key[:64], digest_size=32).digest()

    def _round(self, i: int, x: int) -> int:
        data = x.to_bytes(max(8, (x.bit_length() + 7) // 8), "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=24, salt=bytes([i])).digest(), "big")

    def _step(self, x: int) -> int:
        a, b = divmod(x, self.right)
        for i in range(ROUNDS):
            if i % 2:
                b = (b + self._round(i, a)) % self.right
            else:
                a = (a + self._round(i, b)) % self.left
        return a * self.right + b

    def _back(self, x: int) -> int:
        a, b = divmod(x, self.right)
        for i in reversed(range(ROUNDS)):
            if i % 2:
                b = (b - self._round(i, a)) % self.right
            else:
                a = (a - self._round(i, b)) % self.left
        return a * self.right + b

    def __call__(self, x: int) -> int:
        """The image of x: the network again and again until it lands below size."""
        y = self._step(x)
        while y >= self.size:
            y = self._step(y)
        return y

    def inverse(self, y: int) -> int:
        x = self._back(y)
        while x >= self.size:
            x = self._back(x)
        return x


@lru_cache(4096)
def feistel(key: bytes, tweak: str, size: int) -> Feistel:
    return Feistel(key, tweak, size)


def permuted(key: bytes, kind: str, text: str, alphabet: str) -> str:
    """text, a string over alphabet, permuted among the strings of its length."""
    if not text:
        return text
    base, x = len(alphabet), 0
    for c in text:
        x = x * base + alphabet.index(c)
    y = feistel(key, f"{kind}/{base}", base ** len(text))(x)
    out = []
    for _ in text:
        y, r = divmod(y, base)
        out.append(alphabet[r])
    return "".join(reversed(out))


def _refill(template: str, classes: str, fresh: str) -> str:
    """Puts the characters of fresh where template has characters of classes; the rest stays."""
    it = iter(fresh)
    return "".join(next(it) if c in classes else c for c in template)


def luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total


def card(key: bytes, found: str) -> str | None:
    """13 to 19 digits that pass the Luhn test; the result passes it too. Numbers that fail it are no cards and stay."""
    digits = re.sub(r"\D", "", found)
    if not 13 <= len(digits) <= 19 or luhn_sum(digits) % 10:
        return None
    body = permuted(key, "card", digits[:-1], _DIGITS)
    return _refill(found, _DIGITS, body + str(-luhn_sum(body + "0") % 10))


def ip(key: bytes, found: str) -> str | None:
    """An IPv4 address: four numbers up to 255 without leading zeros."""
    parts = found.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = 0
    for p in parts:
        x = x << 8 | int(p)
    y = feistel(key, "ip", 1 << 32)(x)
    return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))


def phone(key: bytes, found: str) -> str | None:
    """7 to 15 digits with separators; a leading + and country code of one digit stay as they are."""
    digits = re.sub(r"\D", "", found)
    if not 7 <= len(digits) <= 15:
        return None
    fixed = 1 if found.startswith("+") else 0
    return _refill(found, _DIGITS, digits[:fixed] + permuted(key, "phone", digits[fixed:], _DIGITS))


def social(key: bytes, found: str) -> str | None:
    """A US social security number: area not 000, 666 or 9xx, group not 00, serial not 0000."""
    area, group, serial = (int(x) for x in found.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    y = feistel(key, "social", 898 * 99 * 9999)((place * 99 + group - 1) * 9999 + serial - 1)
    y, serial = divmod(y, 9999)
    place, group = divmod(y, 99)
    area = place + 1 + (place + 1 >= 666)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def iban(key: bytes, found: str) -> str | None:
    """An IBAN whose check digits hold; country and the kinds of characters stay, check digits are made anew."""
    plain = re.sub(r"\s", "", found)

    def rest(s: str) -> int:
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97

    if not 15 <= len(plain) <= 34 or rest(plain) != 1:
        return None
    body = plain[4:]
    digits = permuted(key, "iban", "".join(c for c in body if c in _DIGITS), _DIGITS)
    capitals = permuted(key, "iban", "".join(c for c in body if c not in _DIGITS).lower(), _LETTERS).upper()
    body = _refill(_refill(body, _DIGITS, digits), _LETTERS.upper(), capitals)
    check = 98 - rest(f"{plain[:2]}00{body}")
    return _refill(found, _DIGITS + _LETTERS.upper(), f"{plain[:2]}{check:02d}{body}")


def _day(key: bytes, year: int, month: int, day: int) -> datetime.date | None:
    try:
        n = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= n <= _LAST_DAY:
        return None
    return datetime.date.fromordinal(_FIRST_DAY + feistel(key, "date", _LAST_DAY - _FIRST_DAY + 1)(n - _FIRST_DAY))


def date(key: bytes, found: str) -> str | None:
    """A calendar day of 1900 to 2099 as y-m-d, d.m.y or m/d/y, four digits for the year and two for the rest; the same day has one image in all formats."""
    a, b, c = re.split(r"\D", found)
    if len(a) == 4:
        got = _day(key, int(a), int(b), int(c))
        return got and f"{got.year:04d}{found[4]}{got.month:02d}{found[7]}{got.day:02d}"
    if found[2] == "/":
        got = _day(key, int(c), int(a), int(b))
        return got and f"{got.month:02d}/{got.day:02d}/{got.year:04d}"
    got = _day(key, int(c), int(b), int(a))
    return got and f"{got.day:02d}{found[2]}{got.month:02d}{found[5]}{got.year:04d}"


def email(key: bytes, found: str) -> str | None:
    """An address: letters and digits of the local part and of the domain but for its last label are permuted within their runs' kinds; equal addresses stay equal, upper and lower case alike."""
    local, _, domain = found.rpartition("@")
    host, _, top = domain.rpartition(".")
    if not host:
        return None
    low = f"{local}@{host}".lower()
    letters = permuted(key, "email", "".join(c for c in low if c in _LETTERS), _LETTERS)
    digits = permuted(key, "email", "".join(c for c in low if c in _DIGITS), _DIGITS)
    out = _refill(_refill(low, _LETTERS, letters), _DIGITS, digits)
    if found.isupper():
        out = out.upper()
    return f"{out}.{top}"


def secret(key: bytes, found: str) -> str | None:
    """A token of 32 or more hexadecimal digits, of one case, with both letters and digits."""
    if found.isdigit() or found.isalpha() or not (found.islower() or found.isupper()):
        return None
    out = permuted(key, "secret", found.lower(), _HEX)
    return out.upper() if found.isupper() else out


#: Kinds in order: at one place the first that matches and validates holds. Each pattern begins with
#: a digit, a sign or a letter before which no letter or digit stands. That of cards matches whole
#: runs of groups of digits, of which cards() takes the groups that are cards. No pattern looks back
#: or ahead without bound, so long texts without blanks take time in proportion to their length.
KINDS: list[tuple[str, str, Callable[[bytes, str], str | None]]] = [
    ("email", r"[^\s@<>()\[\],;:\"'|]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,253}[A-Za-z0-9])?\.[A-Za-z]{2,24}", email),
    ("secret", r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])", secret),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", iban),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])", ip),
    ("date", r"(?<![0-9A-Za-z])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9A-Za-z])", date),
    ("social", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", social),
    ("card", r"(?<![0-9A-Za-z])[0-9]+(?:[ -][0-9]+)*(?![0-9A-Za-z])", card),
    ("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])", phone),
    ("phone", r"(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9A-Za-z])", phone),
]
NAMES = list(dict.fromkeys(k for k, _, _ in KINDS))


@lru_cache(1)
def _patterns() -> list[tuple[str, re.Pattern, Callable[[bytes, str], str | None]]]:
    return [(name, re.compile(pattern), f) for name, pattern, f in KINDS]


_GROUP = re.compile(r"[0-9]+")
_HEAD = re.compile(r"[0-9A-Za-z]*[^0-9A-Za-z]*")
#: How the digits of cards are grouped in print. Such a grouping is taken before any other one.
SHAPES = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 1), (4, 4, 4, 4, 3)}


def cards(key: bytes, text: str, lo: int, hi: int, free: Callable[[int, int], bool]) -> list[tuple[int, int, str]]:
    """The cards of a run of groups of digits: of all groups in a row that make one, first those of a card's usual grouping, then the longest, then the first."""
    groups = [m.span() for m in _GROUP.finditer(text, lo, hi)]
    found = []
    for i, (a, _) in enumerate(groups):
        digits = ""
        for j in range(i, len(groups)):
            digits += text[slice(*groups[j])]
            if len(digits) > 19:
                break
            b = groups[j][1]
            if len(digits) >= 13 and luhn_sum(digits) % 10 == 0 and free(a, b):
                usual = i == j or tuple(y - x for x, y in groups[i : j + 1]) in SHAPES
                found.append((not usual, -len(digits), a, b))
    out: list[tuple[int, int, str]] = []
    taken = bytearray(hi - lo) if found else b""
    for _, _, a, b in sorted(found):
        if taken.find(1, a - lo, b - lo) < 0:
            taken[a - lo : b - lo] = b"\1" * (b - a)
            out.append((a, b, card(key, text[a:b])))
    return out


_MAYBE = re.compile(r"[0-9]{3}|@|\.[0-9]|[0-9a-fA-F]{32}")


def spans(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """Values found: (start, end, kind, pseudonym), in order and without overlap. Of two that overlap the one whose kind stands first holds.

    Where a match does not validate or overlaps what is taken, shorter and later ones in it are tried:
    the search goes on one group of letters or digits after its start. Numbers grouped as cards that
    fail the Luhn test stay as they are, so no phone is sought in them.
    """
    if _MAYBE.search(text) is None:
        return []
    taken: list[tuple[int, int, str, str]] = []
    covered = bytearray(len(text))

    def free(lo: int, hi: int) -> bool:
        return covered.find(1, lo, hi) < 0

    def take(lo: int, hi: int, name: str, fresh: str) -> None:
        taken.append((lo, hi, name, fresh))
        covered[lo:hi] = b"\1" * (hi - lo)

    barred: list[tuple[int, int]] = []
    for name, pattern, f in _patterns():
        if name == "email" and "@" not in text:
            continue
        if name == "phone":  # numbers grouped as cards that are none
            for lo, hi in barred:
                covered[lo:hi] = b"\1" * (hi - lo)
        at = 0
        while m := pattern.search(text, at):
            lo, hi = m.span()
            at = hi
            if name == "card":
                got = cards(key, text, lo, hi, free)
                for a, b, fresh in got:
                    take(a, b, name, fresh)
                if not got and tuple(map(len, _GROUP.findall(m.group(0)))) in SHAPES:
                    barred.append((lo, hi))
                continue
            ends = [hi]
            if name == "iban":  # words of capitals or numbers may follow it
                ends += [lo + i for i in range(hi - lo - 1, 14, -1) if text[lo + i] == " "]
            for end in ends:
                fresh = f(key, text[lo:end]) if free(lo, end) else None
                if fresh is not None:
                    take(lo, end, name, fresh)
                    at = end
                    break
            else:
                at = max(lo + 1, _HEAD.match(text, lo).end())
                while at > lo + 1 and text[at - 1] in "+(":  # signs that a phone begins with
                    at -= 1
    return sorted(taken)


def replaced(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for lo, hi, _, fresh in found:
        out += text[at:lo], fresh
        at = hi
    return "".join([*out, text[at:]])


#: The setting that holds the key of the queries, and the key of sessions without it, which is public: for trials only.
KEY_SETTING, TRIAL_KEY = "spark.geoloom.pseudonyms.key", "a key for trials, known to all"


def session_key(spark: SparkSession) -> bytes:
    return hashlib.blake2b((spark.conf.get(KEY_SETTING, None) or TRIAL_KEY).encode()).digest()


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with text_col rewritten: every value of KINDS that validates is replaced by another of its format.

    Each kind is a keyed permutation, so equal values stay equal in all documents and different ones
    stay different. counts adds n_pii (values replaced) and pii_kinds (their kinds, sorted, joined
    by commas). Null stays null, empty stays empty; rows and other columns, n_chars among them, are
    kept as they are: lengths change only where an IP address does. One pass, no shuffle.
    """
    bounded_batches(docs.sparkSession)
    drop = [c for c in ("n_pii", "pii_kinds") if counts and c in docs.columns]
    docs = docs.drop(*drop)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, kinds = [], [], []
            for value in batch.column(at):
                text = value.as_py()
                found = spans(text, key) if text else []
                texts.append(replaced(text, found) if found else text)
                n.append(len(found))
                kinds.append(",".join(sorted({k for _, _, k, _ in found})))
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if counts:
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(n, pa.int64()), pa.array(kinds)], names=[*out.schema.names, "n_pii", "pii_kinds"])
            yield out

    schema = docs.schema
    if counts:
        schema = docs.withColumn("n_pii", F.lit(0).cast("long")).withColumn("pii_kinds", F.lit("")).schema
    return docs.mapInArrow(run, schema)


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and how many values of which kinds were replaced."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), session_key(spark), counts=True)
