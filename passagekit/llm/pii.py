"""Personal data replaced by keyed surrogates.

Detected e-mail addresses, telephone, card, account and social security numbers, network
addresses, secrets and person names are replaced by surrogates of the same type and format: digits stay
digits, letters keep their script, case and vowel pattern, valid check digits of cards and accounts stay
valid, a telephone number is the same one in any format, a part of a name that the text has is found where
it stands alone, and known given names are exchanged for names of the same gender and script.

A surrogate is a keyed permutation, without fixed points, of all values of the same
shape. So the same value has the same surrogate in every document and on every machine
(coreference), and different values have different ones (distinctness) without any table of
the values seen. Where a shape also holds values that are exchanged in another way, a
surrogate that collides with those is permuted again. :func:`collisions` audits both on a corpus.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm.common import import_on_workers, table

#: Key of the registered query; applications pass their own secret.
KEY = b"surrogates of the test tables"
ROUNDS = 6
#: Characters that are permuted together.
STRETCH = 256

# Letters that may stand for each other, lower case, by script.
LETTERS = (
    "aeiouy",
    "bcdfghjklmnpqrstvwxz",
    "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ",
    "çðñþßšžłćčńśźż",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщ",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
    "άέήίόύώ",
    "".join(map(chr, range(0x05D0, 0x05EB))),
    "".join(map(chr, range(0x0627, 0x063B))),
    "".join(map(chr, range(0x0905, 0x093A))),
    "".join(map(chr, range(0x3042, 0x3094))),
    "".join(map(chr, range(0x30A2, 0x30F5))),
    "".join(map(chr, range(0x4E00, 0xA000))),
    "".join(map(chr, range(0xAC00, 0xD7A4))),
)
DIGITS = "0123456789"
HEX = "0123456789abcdef"
# Given names by gender and script.
GIVEN = {
    "female latin": "Alice Barbara Camila Charlotte Claudia Deborah Emma Frances Gabriela Heidi Isabella Julia "
    "Katharina Laura Lucía Margaret Monique Olivia Patricia Sabine Sophie Susan Ursula Victoria",
    "male latin": "Albert Benjamin Charles David Edward Francisco Frank George Henri Hugo Jakob James "
    "José Julien Karl Lukas Michael Oliver Pablo Paul Philippe Robert Stefan William",
    "female cyrillic": "Анна Вера Галина Екатерина Ирина Людмила Мария Надежда Ольга Светлана Татьяна Юлия",
    "male cyrillic": "Алексей Борис Виктор Григорий Дмитрий Иван Михаил Николай Павел Сергей Фёдор Юрий",
}
# Forms of address that stand before a name.
ADDRESS = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Don Doña Господин Госпожа".split()

_CLASS = {c: letters for letters in LETTERS for c in letters} | {c: DIGITS for c in DIGITS}
_NAMES = {name: (group, names.split()) for group, names in GIVEN.items() for name in names.split()}


class Entity(NamedTuple):
    """Something detected in a text, with what stands in its place."""

    kind: str
    start: int
    end: int
    surrogate: str


class Surrogates:
    """Keyed permutations of the values of each shape."""

    def __init__(self, key: bytes):
        self._key = hashlib.blake2b(key, digest_size=32).digest()
        self._orders: dict[str, dict[str, str]] = {}

    def _random(self, *parts: object) -> int:
        text = "\x1f".join(map(str, parts)).encode()
        return int.from_bytes(hashlib.blake2b(text, key=self._key, digest_size=32).digest())

    def _mixed(self, x: int, size: int, label: str, back: bool = False) -> int:
        """A keyed permutation of 0..size-1 (a Feistel network that walks on until inside), or its inverse."""
        low = math.isqrt(size - 1) + 1
        high = -(-size // low)
        while True:
            a, b = divmod(x, low)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if i % 2:
                    b = (b + sign * self._random(label, size, i, a) * self._stretch(low)) % low
                else:
                    a = (a + sign * self._random(label, size, i, b) * self._stretch(high)) % high
            x = a * low + b
            if x < size:
                return x

    @staticmethod
    def _stretch(size: int) -> int:
        """An odd factor that spreads 256 random bits over larger sizes."""
        return (1 << max(0, size.bit_length() - 192)) | 1

    def number(self, x: int, size: int, label: str) -> int:
        """Another number below ``size``: one keyed step between the permuted numbers, so never ``x`` itself."""
        if size < 2:
            return x
        step = 1 + self._random("step", label, size) % (size - 1)
        return self._mixed((self._mixed(x, size, label) + step) % size, size, label, back=True)

    def shaped(self, value: str, label: str, alphabets: dict[str, str] = _CLASS) -> str:
        """``value`` with every character exchanged within its class; case and other characters stay.

        A long value is permuted in stretches, each by itself, so that the work grows with its length.
        """
        if len(value) > STRETCH:
            parts = [value[i : i + STRETCH] for i in range(0, len(value), STRETCH)]
            return "".join(self.shaped(part, f"{label} {i}", alphabets) for i, part in enumerate(parts))
        lower = [c if c in alphabets else c.lower() for c in value]
        classes = [alphabets.get(c) for c in lower]
        x, size = 0, 1
        for c, letters in zip(lower, classes, strict=True):
            if letters:
                x, size = x * len(letters) + letters.index(c), size * len(letters)
        shape = "".join(letters[0] if letters else c for c, letters in zip(lower, classes, strict=True))
        x = self.number(x, size, f"{label} {shape}")
        out = list(value)
        for i in reversed(range(len(value))):
            if letters := classes[i]:
                x, at = divmod(x, len(letters))
                out[i] = letters[at].upper() if value[i] != lower[i] else letters[at]
        return "".join(out)

    def known_name(self, name: str) -> str:
        """Another name of the same gender and script: the next one in a keyed order of them."""
        group, names = _NAMES[name]
        if group not in self._orders:
            order = sorted(names, key=lambda n: self._random(group, n))
            self._orders[group] = dict(zip(order, order[1:] + order[:1], strict=True))
        return self._orders[group][name]

    def name(self, word: str) -> str:
        if word in _NAMES:
            return self.known_name(word)
        other = self.shaped(word, "name")
        while other in _NAMES and other != word:
            other = self.shaped(other, "name")
        return other

    def of(self, kind: str, value: str) -> str:
        if kind == "email":
            local, domain = value.rsplit("@", 1)
            host, _, end = domain.rpartition(".")
            return f"{self.shaped(local, 'local')}@{self.shaped(host, 'host')}.{end}"
        if kind == "ipv4":
            return self._ipv4(value)
        if kind == "card":
            return self._card(value)
        if kind == "iban":
            return self._iban(value)
        if kind == "secret" and not set(value.lower()) - set(HEX) or kind == "ipv6":
            return self.shaped(value, kind, {c: HEX for c in HEX})
        if kind == "phone":
            return self._phone(value)
        if kind == "name":
            return " ".join(map(self.name, value.split(" ")))
        return self.shaped(value, kind)

    def _ipv4(self, value: str) -> str:
        parts = list(map(int, value.split(".")))
        first = [n for n in range(1, 224) if n not in (10, 127)]
        # Private, loopback and multicast addresses keep their first number.
        fixed = parts[0] not in first
        x = 0 if fixed else first.index(parts[0])
        for part in parts[1:]:
            x = x * 256 + part
        x = self.number(x, 256**3 * (1 if fixed else len(first)), f"ipv4 {parts[0]}" if fixed else "ipv4")
        head = parts[0] if fixed else first[x >> 24]
        return f"{head}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"

    def _phone(self, value: str) -> str:
        """The same national number gets the same digits in whatever format it is written."""
        digits = "".join(c for c in value if c.isdigit())
        # What stays: the country code, or the 0 before a national number.
        code = "0" if digits[0] == "0" else ""
        if value[0] == "+":
            code = next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])
        # Ten digits without a code are of the plan that has the code 1.
        plan = code or ("1" if len(digits) == 10 else "")
        fresh = iter(code + self.shaped(digits[len(code) :], f"phone {plan}"))
        return "".join(next(fresh) if c.isdigit() else c for c in value)

    def _iban(self, value: str) -> str:
        """Right check digits stay right and wrong ones wrong, by permuting each kind among itself."""
        plain = value.replace(" ", "")
        country, check, body = plain[:2], plain[2:4], plain[4:]
        if iban_check(country, body) == check:
            other = self.shaped(body, f"iban {country}")
            fresh = country + iban_check(country, other) + other
        else:
            other = self.shaped(check + body, f"iban {country} wrong")
            while iban_check(country, other[2:]) == other[:2]:
                other = self.shaped(other, f"iban {country} wrong")
            fresh = country + other
        left = iter(fresh)
        return "".join(c if c == " " else next(left) for c in value)

    def _card(self, value: str) -> str:
        digits = [c for c in value if c.isdigit()]
        body, check = "".join(digits[:-1]), int(digits[-1])
        wrong = (check - luhn(body)) % 10
        other = self.shaped(body, f"card {wrong}")
        fresh = iter(other + str((luhn(other) + wrong) % 10))
        return "".join(next(fresh) if c.isdigit() else c for c in value)


def iban_check(country: str, body: str) -> str:
    """The check digits of an account number without them."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{body}{country}00')) % 97:02d}"


def luhn(body: str) -> int:
    """The check digit of a card number without it."""
    total = 0
    for i, c in enumerate(reversed(body)):
        double = int(c) * (2 if i % 2 == 0 else 1)
        total += double - 9 if double > 9 else double
    return -total % 10


_LOCAL = set(".+-_%")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
#: Country codes of one and of two digits; all others have three.
SHORT_CODES = {"1", "7"} | set(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66"
    " 81 82 84 86 90 91 92 93 94 95 98".split()
)
#: In the order in which they win where they overlap; the value is the last group.
PATTERNS = (
    ("secret", re.compile(r"""(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\b\s{0,4}[:=]\s{0,4}["']?([A-Za-z0-9+/_-]{16,})""")),
    ("secret", re.compile(r"""(?i)\bpassw(?:or)?d\b\s{0,4}[:=]\s{0,4}["']?([^\s"']{6,})""")),
    ("secret", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)([0-9A-Z]{16})(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])gh[pousr]_([A-Za-z0-9]{20,})(?![A-Za-z0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("ipv6", re.compile(r"(?<![0-9A-Fa-f:])((?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])")),
    ("ipv6", re.compile(r"(?<![0-9A-Za-z:.])([0-9A-Fa-f:]{2,37}::?[0-9A-Fa-f:]{0,37})(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9A-Za-z.])((?:[0-9][ -]?){12,18}[0-9])(?![0-9A-Za-z]|\.[0-9])")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z-])")),
    ("ipv4", re.compile(r"(?<![0-9A-Za-z.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?![0-9A-Za-z]|\.[0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4})(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])((?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(0[1-9](?:[ .-][0-9]{2}){4})(?![0-9A-Za-z]|[ .-][0-9])")),
)
#: Texts without any of these, in lower case, have none of the secrets above, one by one.
SECRET_HINTS = (
    ("token", "secret", "passw", "key"),
    ("passw",),
    ("private key-----",),
    ("akia", "asia"),
    ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
)
_WORD = r"[^\W\d_a-zß-öø-ÿа-яё][^\W\d_]{2,}(?:[-'][^\W\d_]{2,})?"
_ADDRESSED = re.compile(rf"(?<!\w)(?:{'|'.join(ADDRESS)})\.? ({_WORD}(?: {_WORD})?)(?!\w)")
_GIVEN = re.compile(rf"(?<!\w)((?:{'|'.join(_NAMES)}) {_WORD})(?!\w)")
_HINTS = re.compile(rf"(?<!\w)(?:{'|'.join([*ADDRESS, *_NAMES])})(?!\w)")
_CAPITALISED = re.compile(rf"(?<!\w){_WORD}(?!\w)")
_FIGURE = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        # No sign stands before the sign, so that nothing is walked through twice.
        while start > done and (text[start - 1].isalnum() or text[start - 1] in _LOCAL):
            start -= 1
        while start < at and text[start] in _LOCAL:
            start += 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _mentions(text: str, names: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Where a part of a name that the text has stands alone. Parts have their surrogates one by one."""
    parts = {part for start, end in names for part in text[start:end].split(" ")}
    if parts:
        for match in _CAPITALISED.finditer(text):
            if match[0] in parts:
                yield match.span()


def _is_address(kind: str, value: str) -> bool:
    """False for what only looks like a network address."""
    if kind == "ipv4":
        return all(int(p) < 256 for p in value.split("."))
    if kind == "ipv6":
        # Two short words around colons are code rather than an address.
        if sum(c != ":" for c in value) < 5 or not _FIGURE.search(value):
            return False
        try:
            return bool(ipaddress.IPv6Address(value))
        except ValueError:
            return False
    return True


def detect(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of the entities of a text, in order and without overlaps."""
    found, low = [], text.lower()
    if "@" in text:
        found += [(0, start, end, "email") for start, end in _emails(text)]
    if _FIGURE.search(text):
        for rank, (kind, pattern) in enumerate(PATTERNS, 2):
            if kind != "secret":
                found += [(rank, *m.span(1), kind) for m in pattern.finditer(text)]
    secrets = (pattern for kind, pattern in PATTERNS if kind == "secret")
    for hints, pattern in zip(SECRET_HINTS, secrets, strict=True):
        if any(hint in low for hint in hints):
            found += [(1, *m.span(1), "secret") for m in pattern.finditer(text)]
    if _HINTS.search(text):
        names = [m.span(1) for p in (_ADDRESSED, _GIVEN) for m in p.finditer(text)]
        found += [(20, *span, "name") for span in names]
        found += [(21, *span, "name") for span in _mentions(text, names)]
    found = [x for x in found if _is_address(x[3], text[x[1] : x[2]])]
    # The kinds that win take their place first; then the rest, where room is left.
    kept: list[tuple[str, int, int]] = []
    taken = bytearray(len(text) if found else 0)
    for _, start, end, kind in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            kept.append((kind, start, end))
    return sorted(kept, key=lambda x: x[1])


def entities(text: str, surrogates: Surrogates) -> list[Entity]:
    return [Entity(kind, s, e, surrogates.of(kind, text[s:e])) for kind, s, e in detect(text)]


def replaced(text: str, found: list[Entity]) -> str:
    parts, done = [], 0
    for entity in found:
        parts += [text[done : entity.start], entity.surrogate]
        done = entity.end
    return "".join([*parts, text[done:]])


def redacted(text_col: str = "text", key: bytes = KEY) -> Column:
    """Struct of ``text`` with surrogates and ``n_entities``; a null text stays null, with none."""

    @F.arrow_udf("struct<text: string, n_entities: bigint>")
    def of(texts: pa.Array) -> pa.Array:
        surrogates, out, numbers = Surrogates(key), [], []
        for value in texts:
            text = value.as_py()
            found = entities(text, surrogates) if text else []
            out.append(replaced(text, found) if found else text)
            numbers.append(len(found))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(numbers, pa.int64())], names=["text", "n_entities"])

    return of(F.col(text_col).cast("string"))


def with_surrogates(docs: DataFrame, text_col: str = "text", key: bytes = KEY, count_col: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and their number in ``count_col``.

    Null and empty texts stay as they are, repeated rows are replaced alike, other columns are
    carried along; a column of the name ``count_col`` is overwritten.
    """
    import_on_workers(docs.sparkSession)
    name = "_redacted"
    while name in docs.columns:
        name += "_"
    done = docs.withColumn(name, redacted(text_col, key))
    return done.withColumns({text_col: F.col(f"{name}.text"), count_col: F.col(f"{name}.n_entities")}).drop(name)


def mapping(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """Distinct ``kind``, ``original`` and ``surrogate`` of all entities: as secret as the texts."""
    import_on_workers(docs.sparkSession)

    @F.arrow_udf("array<struct<kind: string, original: string, surrogate: string>>")
    def of(texts: pa.Array) -> pa.Array:
        surrogates = Surrogates(key)
        kind = pa.struct([("kind", pa.string()), ("original", pa.string()), ("surrogate", pa.string())])
        rows = []
        for value in texts:
            text = value.as_py() or ""
            rows.append([{"kind": e.kind, "original": text[e.start : e.end], "surrogate": e.surrogate} for e in entities(text, surrogates)])
        return pa.array(rows, pa.list_(kind))

    return docs.select(F.inline(of(F.col(text_col).cast("string")))).distinct()


def collisions(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """Audit: surrogates that stand for several values of a kind, or values with several; empty if all is well."""
    found = mapping(docs, text_col, key)
    shared = found.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    split = found.groupBy("kind", "original").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.select("kind", F.col("surrogate").alias("value"), "n").unionByName(
        split.select("kind", F.col("original").alias("value"), "n")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
