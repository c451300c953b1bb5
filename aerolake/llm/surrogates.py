"""PII surrogates: detected entities get keyed replacements of the same type, script and format.

A value is what its mentions share: digits of a phone or card, an IBAN without blanks, a mail address in small letters,
an IPv6 address in full. Its letters and digits together are one number of a mixed radix, moved by a keyed Feistel
permutation of exactly the numbers of that shape, in which every character keeps its class and punctuation stays; each
mention renders the result in its own format. So different values of a shape get different surrogates without any table,
and a value gets the same one in every document and format. Cards and IBANs keep valid check digits, cards their first
digit, IBANs and phones their country, addresses of networks their private or public range. Given names and surnames are replaced one by one
(so "Mr. X" and "Mr. Y X" stay linked), by syllables or letters of their script, given names with an ending
for the gender of their title; parts around hyphens and apostrophes are replaced one by one, and particles (van, de la)
stay. Names count without their case, which each mention keeps; a name that follows
a title anywhere in a text is replaced wherever it stands in it as a capitalised word; a given name after a
title of no gender takes the surrogate of the same name with a gender, if the corpus has it.

A check over all distinct entities of the corpus finds surrogates that coincide with each other or with
a real entity; the losers (all but the least value) try again with another tweak until none is left. A
value without a letter or digit of a known alphabet, and one that loses SHAPED_ATTEMPTS times because
its shape has hardly a free value, get keyed letters in the place of their format. These exceptions
alone are broadcast: syllables are added with the number of entities so that about MOST_EXCEPTIONS are
expected at most; beyond 4 * MOST_EXCEPTIONS they are joined to the texts by a shuffle.

Cases: null texts stay null and empty ones empty; a text without entities stays as it is; overlapping
matches count once, the first kind of KINDS wins; of equal surrogates the one of the least value wins;
repeated rows get the same text; very long texts are searched whole, a row at a time; other columns stay
(one named n_entities too, and then the count isn't added); an empty table gives an empty result.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KEY = "surrogates"
MOST_EXCEPTIONS = 100_000
#: Attempts within the shape of a value.
SHAPED_ATTEMPTS = 8
MOST_ATTEMPTS = 64
#: Fewest letters of a surrogate that doesn't keep the format.
LETTERS = 12
ROUNDS = 8
CACHE_SIZE = 200_000

# Titles before names, by gender.
MALE = "Mr Herr Monsieur Sr Señor г-н".split()
FEMALE = "Mrs Ms Miss Frau Madame Mme Mlle Sra Srta Señora г-жа".split()
NEUTRAL = "Dr Prof".split()
# Syllables of surrogate names and endings by gender, by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga ge gi go ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе би бо да де ди до фа фе фи фо га ге ги го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то ва ве ви во".split(),
}
ENDINGS = {("latin", "m"): "n", ("latin", "f"): "lia", ("latin", "n"): "r", ("cyrillic", "m"): "н", ("cyrillic", "f"): "лия", ("cyrillic", "n"): "р", ("greek", "m"): "ς", ("greek", "f"): "λια", ("greek", "n"): "ρ"}
# First and last code point of the letters that make names of other scripts, one for each syllable.
LETTERS_OF = {"greek": (0x3B1, 0x3C1), "hebrew": (0x5D0, 0x5E9), "arabic": (0x628, 0x63A), "devanagari": (0x915, 0x939), "thai": (0xE01, 0xE2E), "georgian": (0x10D0, 0x10F0), "hangul": (0xAC00, 0xD7A3), "kana": (0x30AB, 0x30DD), "han": (0x4E00, 0x9FA5)}
# Where the letters of each script lie.
SCRIPTS = {"greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "hebrew": (0x590, 0x5FF), "arabic": (0x600, 0x6FF), "devanagari": (0x900, 0x97F), "thai": (0xE00, 0xE7F), "georgian": (0x10A0, 0x10FF), "kana": (0x3040, 0x30FF), "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7AF)}

# Words between given names and surnames, which stay.
PARTICLES = "van von der den de del della da di du la le los las dos das ten ter zu zum zur af av bin ibn al el".split()
# Calling codes of one and two digits; others have three.
CODES = {"1", "7"} | {str(x) for x in (20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98)}
_HEX = "[0-9A-Fa-f]{1,4}"
#: A capitalised word with parts, after particles.
_NAME = rf"(?:(?:{'|'.join(PARTICLES)}) )*[^\W\d_a-zа-я](?:[^\W\d_]|['’-](?=[^\W\d_]))+"

KINDS = {
    "email": r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[\w-]*\w",
    "secret": r"\b(?:AKIA[0-9A-Z]{12,}|ghp_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9-]{16,})\b|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)[^\s\"']{6,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip6": rf"(?<![\w:])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]*[0-9])(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\w+])\+?\d{0,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}\b|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,5}){2,5}\b|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.-])\d{3} \d{3} \d{4}(?![\w-])",
    "name": rf"(?<!\w)(?:{'|'.join([*MALE, *FEMALE, *NEUTRAL])})\.? {_NAME}(?: {_NAME})?",
}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
_MAYBE = re.compile(r"[0-9@=:]|\b(?:" + "|".join([*MALE, *FEMALE, *NEUTRAL]) + r")\b")
_ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?")


def permute(number: int, size: int, tweak: str, key: str = KEY) -> int:
    """A keyed permutation of 0..size-1, another one for each tweak: Feistel, walked on into range."""
    if size < 2:
        return number
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, half // 8 + 1
    while True:
        hi, lo = number >> half, number & mask
        for r in range(ROUNDS):
            f = blake2b(lo.to_bytes(width, "big") + bytes([r]) + tweak.encode(), key=key.encode()[:64], digest_size=width)
            hi, lo = lo, hi ^ (int.from_bytes(f.digest(), "big") & mask)
        number = hi << half | lo
        if number < size:
            return number


def _alphabet(c: str, hexa: bool) -> tuple[str, int] | None:
    """First character and size of the class that a character keeps; None: it stays."""
    if c.isdecimal() and c.isascii():
        return ("hex", 16) if hexa else ("0", 10)
    if hexa and c in "abcdef":
        return "hex", 16
    for first, n in (("a", 26), ("A", 26), ("а", 32), ("А", 32), ("α", 25), ("Α", 25), ("à", 23), ("À", 23), ("ø", 8), ("Ø", 7)):
        if 0 <= ord(c) - ord(first) < n:
            return first, n
    return None


def reshape(value: str, tweak: str, key: str = KEY, hexa: bool = False) -> str:
    """Another value of the same shape: every letter and digit keeps its class, the rest stays."""
    classes = [_alphabet(c, hexa) for c in value]
    number, size = 0, 1
    for c, k in zip(value, classes, strict=True):
        if k:
            number, size = number * k[1] + (int(c, 16) if k[0] == "hex" else ord(c) - ord(k[0])), size * k[1]
    shape = "".join(k[0] if k else c for c, k in zip(value, classes, strict=True))
    number = permute(number, size, f"{tweak}|{shape}", key)
    out = []
    for c, k in zip(reversed(value), reversed(classes), strict=True):
        if k:
            number, d = divmod(number, k[1])
            c = "0123456789abcdef"[d] if k[0] == "hex" else chr(ord(k[0]) + d)
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The check digit for these digits."""
    doubled = [int(d) * 2 if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits))]
    return -sum(d - 9 if d > 9 else d for d in doubled) % 10


def _iban_check(country: str, rest: str) -> str:
    """The two check digits."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{rest}{country}00')) % 97:02d}"


def _code(phone: str) -> str:
    """The plus and country of a number that has them."""
    return "+" + next((phone[1 : 1 + n] for n in (1, 2) if phone[1 : 1 + n] in CODES), phone[1:4]) if phone[0] == "+" else ""


def _network(parts: list[int]) -> str:
    a, b = parts[:2]
    return "10" if a == 10 else "192.168" if (a, b) == (192, 168) else "127" if a == 127 else "public" if 1 <= a <= 223 else "other"


def letters(kind: str, value: str, attempt: int, key: str = KEY) -> str:
    """A surrogate that doesn't keep the format: keyed small letters."""
    count = max(LETTERS, len(value)) + attempt
    h = int.from_bytes(blake2b(f"{kind}|{attempt}|letters|{value}".encode(), key=key.encode()[:64], digest_size=64).digest(), "big")
    return "".join(chr(97 + h // 26**i % 26) for i in range(min(count, 100)))


def surrogate(kind: str, value: str, attempt: int = 0, syllables: int = 4, key: str = KEY) -> str:
    """The replacement of an entity; kinds given:m, given:f, given:n and surname are parts of names."""
    if is_name(kind):
        return shaped(kind, value, attempt, syllables, key)
    if attempt >= SHAPED_ATTEMPTS:
        return letters(kind, value, attempt, key)
    new = shaped(kind, value, attempt, syllables, key)
    if new == value and all(shaped(kind, value, SHAPED_ATTEMPTS + k, syllables, key) == value for k in range(3)):
        return letters(kind, value, attempt, key)
    return new


def script_of(value: str) -> str:
    return next((s for s, (a, b) in SCRIPTS.items() if a <= ord(value[0]) <= b), "latin")


def _syllabic(kind: str, value: str, tweak: str, syllables: int, key: str) -> str:
    """A name in the script of the value, with the ending of its kind."""
    script = script_of(value)
    parts = SYLLABLES.get(script) or [chr(c) for c in range(LETTERS_OF[script][0], LETTERS_OF[script][1] + 1)]
    h = int.from_bytes(blake2b(f"{tweak}|{value}".encode(), key=key.encode()[:64], digest_size=16).digest(), "big")
    out = []
    for _ in range(syllables):
        h, d = divmod(h, len(parts))
        out.append(parts[d])
    return ("".join(out) + (ENDINGS.get((script, kind[-1]), "") if kind.startswith("given") else "")).capitalize()


def shaped(kind: str, value: str, attempt: int = 0, syllables: int = 4, key: str = KEY) -> str:
    """The replacement in the format of the value."""
    tweak = f"{kind}|{attempt}"
    if is_name(kind):
        pieces = re.split(r"(['’-])", value)
        if len(pieces) > 1:  # each part for itself, though another one in another name
            return "".join(p if i % 2 else _syllabic(kind, p, f"{tweak}|{value}|{i}", syllables + attempt, key) for i, p in enumerate(pieces))
        return _syllabic(kind, value, tweak, syllables + attempt, key)
    if kind == "card":
        if int(value[-1]) != _luhn(value[:-1]):
            return value[0] + reshape(value[1:], f"{tweak}|{value[0]}", key)
        new = value[0] + reshape(value[1:-1], f"{tweak}|{value[0]}", key)
        return new + str(_luhn(new))
    if kind == "ip6":  # within its first 16 bits
        number = int(ipaddress.IPv6Address(value))
        return ipaddress.IPv6Address(number >> 112 << 112 | permute(number & (1 << 112) - 1, 1 << 112, f"{tweak}|{number >> 112}", key)).exploded
    if kind == "ip":
        parts = [int(x) for x in value.split(".")]
        if max(parts) > 255:
            return reshape(value, tweak, key)
        group, number = _network(parts), int.from_bytes(bytes(parts), "big")
        while True:  # walk on until the range is the same: a permutation of that range
            number = permute(number, 1 << 32, tweak, key) if group in ("public", "other") else number & ~0xFFFF | permute(number & 0xFFFF, 1 << 16, tweak, key)
            if _network(list(number.to_bytes(4, "big"))) == group:
                return ".".join(map(str, number.to_bytes(4, "big")))
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        return reshape(f"{local}@{host}", f"{tweak}|{top}", key) + f".{top}"
    if kind == "iban":
        country, rest = value[:2], value[4:]
        if value[2:4] != _iban_check(country, rest):
            return country + reshape(value[2:], f"{tweak}|{country}", key)
        new = reshape(rest, f"{tweak}|{country}", key)
        return country + _iban_check(country, new) + new
    if kind == "phone" and (code := _code(value)):
        return code + reshape(value[len(code) :], f"{tweak}|{code}", key)
    if kind == "secret":
        prefix = re.match(r"AKIA|ghp_|sk-|", value)[0]
        rest = value[len(prefix) :]
        return prefix + reshape(rest, f"{tweak}|{prefix}", key, hexa=re.fullmatch(r"[0-9a-f]{8,}", rest) is not None)
    return reshape(value, tweak, key)


def is_name(kind: str) -> bool:
    return kind == "surname" or kind.startswith("given")


def value_of(kind: str, mention: str) -> str | None:
    """What the mentions of an entity share; None: it is none."""
    if kind in ("phone", "card"):
        return ("+" if mention[0] == "+" else "") + "".join(c for c in mention if c.isdigit())
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "email":
        return mention.lower()
    if kind == "ip6":
        try:
            return ipaddress.IPv6Address(mention).exploded
        except ValueError:
            return None
    return mention


def render(kind: str, mention: str, new: str) -> str:
    """The surrogate in the format of a mention."""
    if is_name(kind) or kind == "email":
        return new.upper() if len(mention) > 1 and mention.isupper() else new
    if kind == "ip6" and ":" in new:
        return ipaddress.IPv6Address(new).compressed if "::" in mention else new
    if kind in ("phone", "card", "iban"):
        own = [c for c in new if c.isalnum()]
        if len(own) == sum(c.isalnum() for c in mention):
            it = iter(own)
            return "".join(next(it) if c.isalnum() else c for c in mention)
    return new


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, value) of what is replaced, in order; names capitalised, whatever their case."""
    if not text or not _MAYBE.search(text):
        return []
    out, names, forms = [], {}, {}
    for m in _FIND.finditer(text):
        kind, begin, end = m.lastgroup, m.start(), m.end()
        if kind == "secret" and (a := _ASSIGNED.match(m[0])):
            begin += a.end()
        if kind == "name":
            title, *parts = (x for x in re.finditer(r"[^ ]+", m[0]) if x[0] not in PARTICLES)
            t = title[0].rstrip(".")
            gender = "m" if t in MALE else "f" if t in FEMALE else "n"
            kinds = [f"given:{gender}", "surname"] if len(parts) > 1 else ["surname"]
            for n, k in zip(parts, kinds, strict=True):
                value = n[0].capitalize()
                forms |= {f: value for f in (n[0], value, n[0].upper())}
                out.append((begin + n.start(), begin + n.end(), k, value))
                if names.get(value, "given:n") == "given:n":  # a known gender or a surname is better than none
                    names[value] = k
        elif (value := value_of(kind, text[begin:end])) is not None:
            out.append((begin, end, kind, value))
    if names:
        # Other mentions of these people, without a title.
        any_form = "|".join(re.escape(f) for f in sorted(forms, key=lambda f: (-len(f), f)))
        taken, k = [(b, e) for b, e, *_ in out], 0
        for m in re.finditer(rf"(?<!\w)(?:{any_form})(?!\w)", text):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if k == len(taken) or taken[k][0] >= m.end():
                out.append((m.start(), m.end(), names[forms[m[0]]], forms[m[0]]))
        out.sort()
    return out


def _given(attempt: int, syllables: int, key: str):
    def give(kind: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, v, attempt, syllables, key) for k, v in zip(kind, value, strict=True)], dtype=object)

    return F.pandas_udf(give, "string")


def assign(found: DataFrame, syllables: int, key: str = KEY) -> DataFrame:
    """Surrogates of distinct entities (kind, value), each free of collisions, with the attempt."""
    spark = found.sparkSession
    common.ship(spark)
    real = found.select(F.col("value").alias("surrogate")).distinct()
    pending, accepted, attempt = found, None, 0
    while True:
        tried = common.stage(pending.withColumn("surrogate", _given(attempt, syllables, key)("kind", "value")))
        winners = tried.groupBy("surrogate").agg(F.min(F.struct("value", "kind")).alias("least")).select("surrogate", "least.value", "least.kind").join(real, "surrogate", "left_anti")
        if accepted is not None:
            winners = winners.join(accepted.select("surrogate"), "surrogate", "left_anti")
        new = common.stage(winners.select("kind", "value", "surrogate", F.lit(attempt).alias("attempt")))
        accepted = new if accepted is None else accepted.unionAll(new)
        pending = common.stage(tried.select("kind", "value").join(new.select("kind", "value"), ["kind", "value"], "left_anti"))
        if pending.isEmpty():
            return accepted
        attempt += 1
        if attempt > MOST_ATTEMPTS:  # each attempt has more letters or syllables than the one before
            raise RuntimeError(f"entities without a free surrogate after {MOST_ATTEMPTS} attempts")


def with_exceptions(d: DataFrame, odd: DataFrame) -> DataFrame:
    """d with the exceptions (kind, value, surrogate) that its texts hold as the last column."""

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [(i, k, v) for i, t in enumerate(b.column(0).to_pylist()) for k, v in {(k, v) for _, _, k, v in entities(t)}]
            rows = pa.array([i for i, _, _ in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(1).take(rows), b.column(2).take(rows), pa.array([k for _, k, _ in hits], pa.string()), pa.array([v for *_, v in hits], pa.string())], ["k1", "k2", "kind", "value"])

    held = common.map_batches(d.select("text", *common.text_key()), detect, "k1 bigint, k2 bigint, kind string, value string").distinct()
    lists = held.join(odd, ["kind", "value"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("odd"))
    h1, h2 = common.text_key()
    left = d.select(F.struct(*[f"`{c}`" for c in d.columns]).alias("_own"), h1, h2)
    return left.join(lists, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left").select("_own.*", F.col("odd").alias("_odd"))


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with surrogates in ``text``, and n_entities (how many were replaced) as the last column, unless
    docs have a column of that name."""
    spark = docs.sparkSession

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = list({(k, v) for t in b.column(0).to_pylist() for _, _, k, v in entities(t)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.string()), pa.array([v for _, v in some], pa.string())], ["kind", "value"])

    found = common.stage(common.map_batches(docs.select("text"), detect, "kind string, value string").distinct())
    # John of "Dr John" is John of "Mr John".
    gendered = found.where("kind IN ('given:m', 'given:f')").groupBy("value").agg(F.max("kind").alias("known"))
    neutral = common.stage(found.where("kind = 'given:n'").join(gendered, "value").select("kind", "value", "known"))
    found = common.stage(found.join(neutral.select("kind", "value"), ["kind", "value"], "left_anti"))
    names = found.where("kind = 'surname' OR kind LIKE 'given%'").count()
    syllables = 3
    while len(SYLLABLES["latin"]) ** syllables * 2 * MOST_EXCEPTIONS < names**2 or len(SYLLABLES["latin"]) ** syllables < 100 * names:
        syllables += 1
    given = assign(found, syllables, key)
    same = neutral.join(given.select(F.col("kind").alias("known"), "value", "surrogate"), ["known", "value"]).select("kind", "value", "surrogate")
    odd = common.stage(given.where("attempt > 0").select("kind", "value", "surrogate").unionAll(same))
    few = odd.limit(4 * MOST_EXCEPTIONS + 1).collect()
    if many := len(few) > 4 * MOST_EXCEPTIONS:
        few = []
    exceptions = spark.sparkContext.broadcast({(r["kind"], r["value"]): r["surrogate"] for r in few})

    columns, counted = docs.columns, ["n_entities"] if "n_entities" not in docs.columns else []
    place = columns.index("text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[tuple[str, str], str] = {}
        for b in batches:
            texts, counts = [], []
            own_odd = b.column(len(columns)).to_pylist() if many else [None] * b.num_rows
            for t, some in zip(b.column(place).to_pylist(), own_odd, strict=True):
                odd_here = {(x["kind"], x["value"]): x["surrogate"] for x in some} if some else exceptions.value
                spans, parts, last = entities(t), [], 0
                for begin, end, kind, value in spans:
                    if (new := odd_here.get((kind, value)) or cache.get((kind, value))) is None:
                        if len(cache) >= CACHE_SIZE:
                            cache.clear()
                        new = cache[kind, value] = surrogate(kind, value, 0, syllables, key)
                    parts += [t[last:begin], render(kind, t[begin:end], new)]
                    last = end
                texts.append("".join([*parts, t[last:]]) if spans else t)
                counts.append(len(spans))
            own = list(b.columns)[: len(columns)]
            own[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(counts, pa.int64())][: len(counted)]], [*columns, *counted])

    d = docs
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)
    if many:
        d = with_exceptions(d, odd)
    return common.map_batches(d, replace, f"{schema}, n_entities bigint" if counted else schema)
