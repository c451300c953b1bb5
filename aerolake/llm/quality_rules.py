"""Quality rules: base counts, and the divergence of a document from the language references.

A document goes if its character classes are far from every reference, if its common words are, or if
it holds too few common words at all (tables and lists). References of character classes come from every
language with MIN_DOCUMENTS documents; references of common words from those of COMMON_WORDS. A document
whose ``lang`` has no reference isn't held against those of other languages. Everything is DataFrame functions: counts, a sort of the packed 3-word windows of a document, and
Jensen-Shannon distances between sparse histograms. No row is exploded before the references, so
the only shuffles carry a few numbers for each document.

Cases: a null text counts as empty and an empty text fails the base rules; a null ``lang`` is held
against every reference; a language with too few documents that pass the base rules has no reference, and
its documents are judged by the base rules alone, as all are if there is no reference at all; very long
texts are counted whole; at the limit itself a document stays; repeated rows and doc_ids stay as they are; an
empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import string
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Frequent function words for each language reference.
COMMON_WORDS = {
    "en": "the of and to a in that is was he for it with as on be at by this from or are an not but had his her they have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec elle son".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más o pero sus le ha me si".split(),
}
#: All of them once; the position counts from 1, and 0 stands for every other word.
WORDS = list(dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws))
#: A word's number stands at its CRC-32 modulo the first size at which no two of them meet.
SLOTS = next(n for n in range(len(WORDS), 1 << 20) if len({zlib.crc32(w.encode()) % n for w in WORDS}) == len(WORDS))
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
CHAR_CLASSES = ("upper", "digit", "point", "symbol", "space", "latin1", "beyond", "other")
MIN_WORDS = 50
#: Distance (base 2, 0 to 1) of the character classes above which a document is rejected.
MAX_CHAR_DISTANCE = 0.25
#: A histogram of n words is rough by about 1 / sqrt(n), so word distances are compared times sqrt(n).
#: Their limit comes from the corpus: SPREADS times the lower spread (median less 16th percentile, which
#: bad documents don't widen) above the median, and LEAST_LIMIT medians at least.
SPREADS, LEAST_LIMIT = 4, 1.5
#: Common words of a document, as a part of the least share that a reference has of them, below which it
#: is rejected: the distance of a short text without a common word is no larger than that of clean ones.
LEAST_COMMON = 1 / 3
#: Fewest documents behind a language reference, and the most languages that get one.
MIN_DOCUMENTS, MOST_LANGUAGES = 5, 200


def _long(c: Column) -> Column:
    return c.cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """Columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the two histograms
    ``chars`` (in the order of CHAR_CLASSES) and ``entries`` (word number, count)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", text.alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    d = d.withColumn("n_words", F.size("words"))
    # A window packs its hash (high bits) with its place (low bits), so that one sort of plain
    # longs puts equal windows side by side; the words themselves then confirm it.
    d = d.withColumn("shift", F.length(F.bin(_long(F.col("n_words")))))
    at = lambda i: F.get(F.col("words"), i)
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.col("n_words") - 3)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("hashes", F.transform(starts, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
    # Most documents repeat no window, and a set of their hashes shows it without a sort.
    packed = F.transform("hashes", lambda h, i: F.call_function("shiftleft", h, F.col("shift")).bitwiseOR(_long(i)))
    d = d.withColumn("windows", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("shift")) - 1).cast("int")

    def same(x: Column, y: Column) -> Column:
        hashes = F.call_function("shiftright", x.bitwiseXOR(y), F.col("shift")) == 0
        return hashes & (at(place(x)) == at(place(y))) & (at(place(x) + 1) == at(place(y) + 1)) & (at(place(x) + 2) == at(place(y) + 2))

    # Places k of the sorted windows that equal the one before; both belong to the repeated ones.
    d = d.withColumn("again", F.filter(F.transform("windows", lambda x, k: F.when(same(x, F.get(F.col("windows"), k - 1)), k)), lambda k: k.isNotNull()))
    found = F.array_distinct(F.concat("again", F.transform("again", lambda k: k - 1)))
    d = d.withColumn("repeats", F.sort_array(F.transform(found, lambda k: place(F.get(F.col("windows"), k)))))
    start = F.struct(F.lit(0).cast("int").alias("n"), F.lit(-3).cast("int").alias("last"))
    covered = F.aggregate("repeats", start, lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # What is neither a small letter nor a blank: a short text, for the rarer classes.
    d = d.withColumns({"lines": lines, "n_repeat_words": covered, "word_chars": F.char_length(F.array_join("words", "")), "n_chars": F.char_length("text"), "odd": F.regexp_replace("text", r"[a-z\x20]+", "")})
    d = d.withColumns({"ascii": F.regexp_replace("odd", r"[^\x00-\x7F]+", ""), "far": F.regexp_replace("odd", r"[\x00-\x{24F}]+", "")})
    count = lambda chars: F.char_length("ascii") - F.char_length(F.translate("ascii", chars, ""))
    d = d.withColumn("n_symbols", count(SYMBOLS))
    beyond = F.char_length("far")
    some = [count(string.ascii_uppercase), count(string.digits), count(".,;:!?'\"()-"), F.col("n_symbols"), F.col("n_chars") - F.col("word_chars"), F.char_length("odd") - F.char_length("ascii") - beyond, beyond]
    slots = [0] * SLOTS
    for i, w in enumerate(WORDS, 1):
        slots[zlib.crc32(w.encode()) % SLOTS] = i
    number = lambda w: F.get(F.lit(slots), (F.crc32(w) % SLOTS).cast("int"))
    longest = max(len(w.encode()) for w in WORDS)
    known = F.filter("words", lambda w: (F.octet_length(w) <= longest) & (F.get(F.lit(["", *WORDS]), number(w)) == w))
    d = d.withColumns({"some": F.array(*[_long(x) for x in some]), "numbers": F.sort_array(F.transform(known, number))})
    bounds = F.filter(F.sequence(F.lit(0), F.size("numbers")), lambda b: (b == 0) | (b == F.size("numbers")) | (F.get("numbers", b) != F.get("numbers", b - 1)))
    d = d.withColumn("bounds", bounds)
    entry = lambda i: F.struct(F.get("numbers", F.get("bounds", i)).alias("k"), _long(F.get("bounds", i + 1) - F.get("bounds", i)).alias("c"))
    entries = F.when(F.size("numbers") > 0, F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), entry)).otherwise(F.array().cast("array<struct<k:int,c:bigint>>"))
    others = F.array(F.struct(F.lit(0).alias("k"), _long(F.col("n_words") - F.size("numbers")).alias("c")))
    rest = F.greatest(F.lit(0).cast("long"), _long(F.col("n_chars")) - F.aggregate("some", F.lit(0).cast("long"), lambda a, x: a + x))
    return d.select(
        "doc_id", "lang", _long(F.col("n_words")).alias("n_words"), _long(F.col("word_chars")).alias("word_chars"), _long(F.col("n_symbols")).alias("n_symbols"),
        _long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), _long(F.col("n_repeat_words")).alias("n_repeat_words"),
        F.concat("some", F.array(rest)).alias("chars"), F.concat(others, entries).alias("entries"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(counts: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Mean shares of the character classes and of the common words for each language, over all
    distinct histograms of documents that pass the base rules; so a group of copies weighs as one
    document. Of the MOST_LANGUAGES languages with most documents at most languages times (words +
    classes + 1) numbers reach the driver, whatever the corpus."""
    good = counts.where(~base_failed() & F.col("lang").isNotNull()).select("lang", "chars", "entries").distinct()
    langs = [r["lang"] for r in good.groupBy("lang").count().where(f"count >= {MIN_DOCUMENTS}").orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()]
    good = good.where(F.col("lang").isin(langs)) if langs else good.limit(0)
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + e["c"])
    chars = F.transform("chars", lambda c, i: F.struct((-1 - i).alias("k"), (c / total).alias("p")))
    words = F.transform("entries", lambda e: F.struct(e["k"].alias("k"), (e["c"] / n).alias("p")))
    sums = good.select("lang", F.explode(F.concat(chars, words)).alias("e")).groupBy("lang", "e.k").agg(F.sum("e.p").alias("s")).collect()
    docs = {lang: round(sum(r["s"] for r in sums if r["lang"] == lang and r["k"] < 0)) for lang in langs}
    out = {}
    for lang, count in docs.items():
        if count:
            s = {r["k"]: r["s"] / count for r in sums if r["lang"] == lang}
            out[lang] = ([s.get(-1 - i, 0.0) for i in range(len(CHAR_CLASSES))], [s.get(i, 0.0) for i in range(len(WORDS) + 1)])
    return out


def _term(p: Column, q: Column) -> Column:
    """What a class adds to twice the divergence, beyond the q of classes that a document lacks."""
    m = p + q
    one = lambda v: F.when(v > 0, v * F.log2(2 * v / m)).otherwise(0.0)
    return one(p) + one(q) - q


def distance(pairs: Column, q: Column, total_q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of (class k, share p) pairs to the shares q, which add up to total_q."""
    total = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + _term(e["p"], F.get(q, e["k"])))
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (total + total_q) / 2)))


def word_limit(d: DataFrame) -> float | None:
    """The largest word distance times sqrt(n_words), from the distinct histograms of d; at most a row
    for each hundredth reaches the driver."""
    scaled = F.round(F.col("word_distance") * F.sqrt("n_words"), 2).alias("s")
    rows = d.select(scaled, F.xxhash64("entries").alias("h")).where("s IS NOT NULL").distinct().groupBy("s").count().orderBy("s").collect()
    total = sum(r["count"] for r in rows)
    if total < MIN_DOCUMENTS:
        return None

    def quantile(q: float) -> float:
        seen = 0
        return next(r["s"] for r in rows if (seen := seen + r["count"]) >= q * total)

    return max(quantile(0.5) + SPREADS * (quantile(0.5) - quantile(0.16)), LEAST_LIMIT * quantile(0.5))


def apply_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, the base counts, base_failed, char_distance and
    word_distance (each to the nearest language reference; null without any), kept."""
    counts = common.stage(base_counts(docs))
    refs = references(counts)
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    d = counts.withColumns({
        "base_failed": base_failed(),
        "char_pairs": F.transform("chars", lambda c, i: F.struct(i.alias("k"), F.coalesce(F.try_divide(c, total), F.lit(0.0)).alias("p"))),
        "word_pairs": F.transform("entries", lambda e: F.struct(e["k"].alias("k"), F.coalesce(F.try_divide(e["c"], F.col("n_words")), F.lit(0.0)).alias("p"))),
    })
    null = F.lit(None).cast("double")
    least = lambda xs: F.least(*xs, null) if xs else null  # noqa: E731  null is skipped
    worded = {x: r for x, r in refs.items() if x in COMMON_WORDS}
    known = lambda some: F.col("lang").isNull() | (F.col("lang").isin(list(some)) if some else F.lit(False))
    d = d.withColumns({
        "char_distance": F.when(known(refs), F.array_min(F.transform(F.lit([c for c, _ in refs.values()]), lambda q: distance(F.col("char_pairs"), q, F.lit(1.0))))) if refs else null,
        "word_distance": F.when(known(worded), least([distance(F.col("word_pairs"), F.lit(w), F.lit(float(sum(w)))) for _, w in worded.values()])),
    })
    share = 1 - F.try_divide(F.get("entries", 0)["c"], F.col("n_words"))
    least_share = LEAST_COMMON * min((1 - w[0] for _, w in worded.values()), default=0.0)
    d = d.withColumn("poor", known(worded) & (F.coalesce(share, F.lit(1.0)) < least_share))
    limit = word_limit(d.where("NOT base_failed AND NOT poor"))
    far = F.col("poor") | (F.coalesce(F.col("char_distance"), F.lit(0.0)) > MAX_CHAR_DISTANCE)
    if limit is not None:
        far |= F.coalesce(F.col("word_distance"), F.lit(0.0)) * F.sqrt("n_words") > limit
    kept = ~F.col("base_failed") & ~far
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"), kept.alias("kept"))
