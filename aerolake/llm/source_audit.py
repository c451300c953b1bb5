"""Source divergence audit: how far the words of each source of a language are from those of its other sources, and
which terms set a source apart from its language.

Terms are counted in the tasks that read the texts; the terms in three documents of a language are kept and get a
block (by hash) and a place in it. A group (language and source) is then one packed vector for each block. The groups
of a language have slots and play a round-robin tournament: with m slots (an odd number), the slots whose sum is r
modulo m meet in round r, so every two groups meet once. In a meeting one group stays in its partition and the
packed vector of the other comes to it; both directions are summed at once. As many rounds travel in one shuffle as
keep the vectors under way under ``in_flight`` bytes. The terms of a group are ranked by heaps of 200 in the tasks that hold
its counts, and then by windows over what the heaps gave. All sums are of whole numbers.

Cases: null text, lang and source are ''; a group without a kept term, and a language without one, has its pairs, of
value 0 in the second case; a language of one source has no pair; ties go by item; rows are documents, also repeated
ones and whatever their doc_ids; very long texts are counted in pieces cut between terms; an empty table gives
an empty result; further columns are ignored. Counts in a language may reach 9e15.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Terms in UTF-8, after A-Z have become a-z.
TERM = re.compile(rb"[a-z\x80-\xff]+")
GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
LEAST_DOCUMENTS, BEST, SCALE = 3, 200, 1_000_000_000
#: Terms of a block, entries that a task counts or sums before it gives them on, bytes of a piece of text.
BLOCK, HELD, PIECE = 1 << 14, 300_000, 1 << 20
#: Bytes of packed vectors that one shuffle of rounds may carry.
IN_FLIGHT = 64 << 30


def term_runs(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists for about PIECE bytes each."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield TERM.findall(text[at:end].lower())
        at = end


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of a task's rows, in parts of HELD entries, and one row with a null term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, documents) in held.items():
            terms = [None, *occurrences]
            occurrences[None] = documents[None] = 0
            for i in range(0, len(terms), 20_000):
                some = terms[i : i + 20_000]
                key = [pa.repeat(x, len(some)) for x in (lang, source)]
                n = [pa.array(list(map(c.__getitem__, some)), pa.int64()) for c in (occurrences, documents)]
                yield pa.RecordBatch.from_arrays([*key, pa.array(some, pa.binary()).cast(pa.string()), *n], names=["lang", "source", "term", "c", "d"])
        held.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            occurrences, documents = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(occurrences)
            seen: set[bytes] = set()
            for terms in term_runs(text.as_py().encode()):
                occurrences.update(terms)
                seen.update(terms)
            documents.update(seen)
            size += len(occurrences)
            if size > HELD:
                yield from given()
                size = 0
    yield from given()


def share(c: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (c + 1) / total); c < total. Beyond 64 bits by long division in steps of a thousand."""
    left = c.astype(np.int64) + 1
    if total <= (1 << 63) // SCALE:
        return left * SCALE // total + 1
    out = np.zeros(len(c), np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and shares of a group in a block as bytes: steps between places, then the p."""
    for b in batches:
        out = []
        entries, totals = b.column("entries"), b.column("total").to_pylist()
        for i, total in enumerate(totals):
            some = entries[i].values
            ids, counts = (some.field(k).to_numpy(zero_copy_only=False) if some is not None else np.zeros(0, np.int64) for k in range(2))
            order = np.argsort(ids)
            ids = ids[order].astype(np.int32)
            out.append(zlib.compress(np.diff(ids, prepend=np.int32(0)).astype("<i4").tobytes() + share(counts[order], total).astype("<i8").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(out, pa.binary())], names=[*b.schema.names[:-1], "packed"])


def shares(packed: bytes, size: int, total: int) -> np.ndarray:
    """The p of all terms of a block."""
    raw = zlib.decompress(packed)
    n = len(raw) // 12
    out = np.full(size, 1 + SCALE // total)
    out[np.cumsum(np.frombuffer(raw, "<i4", n))] = np.frombuffer(raw, "<i8", n, 4 * n)
    return out


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of both directions over the blocks of a task. Rows of a home come as itself first, then its visitors."""
    sums: dict[tuple[str, int, int], int] = {}
    home, p = None, np.zeros(0, np.int64)

    def given() -> pa.RecordBatch:
        keys = list(sums)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)), pa.array(list(sums.values()), pa.int64())], names=["lang", "slot", "peer", "value"])
        sums.clear()
        return out

    for b in batches:
        for lang, block, dest, slot, size, total, packed in zip(*(b.column(x).to_pylist() for x in ("lang", "block", "dest", "slot", "size", "total", "packed")), strict=True):
            q = shares(packed, size, total)
            if slot == dest:
                home, p = (lang, block, dest), q
                continue
            if home != (lang, block, dest):
                raise ValueError("a visitor came before its home")
            square = p - q
            square *= square
            for key, value in (((lang, dest, slot), (square // q).sum()), ((lang, slot, dest), (square // p).sum())):
                sums[key] = sums.get(key, 0) + int(value)
            if len(sums) > HELD:
                yield given()
    yield given()


def best_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The BEST terms of each group among a task's rows."""
    heaps: dict[tuple[str, str], list[tuple[int, str]]] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), heap in heaps.items():
            some = heapq.nsmallest(BEST, heap)
            yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(some), pa.string()) for x in (lang, source)), pa.array([t for _, t in some], pa.string()), pa.array([-v for v, _ in some], pa.int64())], names=["lang", "source", "item", "value"])
        heaps.clear()

    for b in batches:
        c, whole, total, lang_total = (b.column(x).to_numpy(zero_copy_only=False) for x in ("c", "whole", "total", "lang_total"))
        langs, sources = (b.column(x).dictionary_encode() for x in ("lang", "source"))
        code = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        terms = b.column("term")
        for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else ():
            key = b.column("lang")[int(rows[0])].as_py(), b.column("source")[int(rows[0])].as_py()
            p = share(c[rows], int(total[rows[0]]))
            q = share(whole[rows], int(lang_total[rows[0]]))
            value = (p - q) ** 2 // q
            heap = heaps.setdefault(key, [])
            size -= len(heap)
            good = p > q
            if len(heap) >= BEST:  # sorted, the first BEST: only what isn't under the last may enter
                good &= value >= -heap[BEST - 1][0]
            heap += [(-int(v), terms[int(i)].as_py()) for v, i in zip(value[good], rows[good], strict=True)]
            if len(heap) > 5 * BEST:
                heap[:] = heapq.nsmallest(BEST, heap)
            elif len(heap) >= BEST and good.any():
                heap.sort()
            size += len(heap)
        if size > HELD:
            yield from given()
            size = 0
    yield from given()


def _rounds(pieces: DataFrame, first: int, last: int) -> DataFrame:
    """Homes and visitors (column ``dest``: the home's slot) of the rounds first to last."""
    slots = F.col("groups") + (F.col("groups") + 1) % 2  # an odd number; one more slot stays empty
    peer = lambda r: F.pmod(r - F.col("slot"), slots)
    # Of a pair the smaller slot stays if their difference is odd: everyone is home about half of the time.
    goes = lambda x: (x != F.col("slot")) & (x < F.col("groups")) & ((F.abs(x - F.col("slot")) % 2 == 1) == (x < F.col("slot")))
    rounds = F.when(F.lit(first) < slots, F.sequence(F.lit(first), F.least(F.lit(last), slots - 1))).otherwise(F.array().cast("array<int>"))
    visitors = pieces.withColumn("dest", F.explode(F.filter(F.transform(rounds, peer), goes)))
    homes = pieces.withColumn("dest", F.col("slot"))
    return homes.unionByName(visitors)


def tournament(pieces: DataFrame, in_flight: int = IN_FLIGHT) -> DataFrame:
    """lang, slot, peer and value of every two groups of a language, both ways. ``pieces``, a staged table, has
    lang, slot, groups (of the language), block, size (terms of the block), total and packed."""
    held = pieces.agg(F.max("groups"), F.sum(F.octet_length("packed") + 64)).first()
    if held[0] is None:
        return pieces.select("lang", "slot", F.col("slot").alias("peer"), F.lit(0).cast("bigint").alias("value"))
    rounds, step = held[0] + (held[0] + 1) % 2, max(1, in_flight // max(1, held[1]))
    out = None
    for first in range(0, rounds, step):
        key = ["lang", "block", "dest"]
        d = _rounds(pieces, first, first + step - 1).repartition(*key).sortWithinPartitions(*key, F.col("slot") != F.col("dest"))
        got = common.map_batches(d.select(*key, "slot", "size", "total", "packed"), meet, "lang string, slot int, peer int, value bigint")
        got = got.groupBy("lang", "slot", "peer").agg(F.sum("value").alias("value"))
        got = common.stage(got) if rounds > step else got
        out = got if out is None else out.unionByName(got)
    return out


def audit(docs: DataFrame, in_flight: int = IN_FLIGHT, block: int = BLOCK) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    d = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = common.map_batches(d, count_terms, "lang string, source string, term string, c bigint, d bigint")
    counts = common.stage(counts.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d")))
    kept = common.stage(counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("c").alias("whole"), F.sum("d").alias("documents")).where(F.col("documents") >= LEAST_DOCUMENTS).drop("documents"))
    langs = common.stage(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("lang_n")))
    placed = kept.join(common.small(langs), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / block)).cast("int"))
    placed = placed.withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1)
    entries = common.stage(counts.where("term IS NOT NULL").join(placed.select("lang", "term", "whole", "block", "id"), ["lang", "term"]).select("lang", "source", "term", "c", "whole", "block", "id"))

    sums = entries.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    groups = groups.withColumns({"slot": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1, "groups": F.count("*").over(Window.partitionBy("lang")).cast("int")})
    groups = common.stage(groups.select("lang", "source", "slot", "groups", "v", (F.col("n") + F.col("v")).alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total")))
    some = common.small(groups)

    sizes = placed.groupBy("lang", "block").agg(F.count("*").cast("int").alias("size"))
    places = groups.where("groups > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("v") / block).cast("int") - 1))))
    vectors = entries.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("id", "c")).alias("entries"))
    pieces = places.join(sizes, ["lang", "block"], "left").join(vectors, ["lang", "source", "block"], "left")
    pieces = pieces.select("lang", "slot", "groups", "block", F.coalesce("size", F.lit(0)).alias("size"), F.greatest("total", F.lit(1)).alias("total"), "entries")
    pieces = common.stage(common.map_batches(pieces, pack, "lang string, slot int, groups int, block int, size int, total bigint, packed binary"))
    pairs = tournament(pieces, in_flight)
    names = lambda slot, name: some.select("lang", F.col("slot").alias(slot), F.col("source").alias(name))
    pairs = pairs.join(names("slot", "source"), ["lang", "slot"]).join(names("peer", "item"), ["lang", "peer"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    held = entries.join(some.select("lang", "source", "total", "lang_total"), ["lang", "source"]).select("lang", "source", "term", "c", "whole", "total", "lang_total")
    terms = common.map_batches(held, best_terms, "lang string, source string, item string, value bigint")
    best = [F.desc("value"), F.asc("item")]
    # What many tasks give for one group is cut down in 16 parts before it meets.
    sixteenth = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(16))).orderBy(*best)
    terms = terms.withColumn("rank", F.row_number().over(sixteenth)).where(F.col("rank") <= BEST).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best)))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= BEST))


#: The same over dense vectors of every group.
SQL = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT d, lang, source, unnest(terms) AS term FROM t),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM t),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + v.v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS BIGINT) AS q
    FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200"""
