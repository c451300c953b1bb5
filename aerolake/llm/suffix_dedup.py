"""Suffix-array dedup: every byte covered by a 400-byte string that also starts elsewhere goes.

1. Winnowing gives each 400-byte string one anchor, the least hash of its 200-byte grams (the last of
   equals); equal strings have equal anchors. Neighbouring strings with the same anchor make a
   context. Only anchors that occur twice can matter, and contexts that occur twice are settled.
2. The other contexts of such anchors are dealt out by anchor, a shard of many anchors gets one suffix
   array by induced sorting, and permuted common prefixes (cut at 400) of neighbouring valid starts
   tell which strings repeat. Contexts of an anchor with more than HOT of them are compared by
   distributed counts of their strings' hashes instead, so no task holds an unbounded group.
3. The starts are joined to the documents by text, whose spans are cut out.

Equal texts share a key (a 64-bit hash with the length), so copies need no row number. What is joined grows with the
corpus, so nothing of it is broadcast, at any size.

Cases: a null text counts as empty; texts under 400 bytes keep everything; repeats inside one text
count; repeated rows remove each other whole if long enough; a string may begin or end inside a
character, and the digest is of the bytes that are left; hashes of very long texts are taken from blocks
of whole texts, so a task needs about 60 times the bytes of its longest text; contexts with equal anchors
meet whatever their order (ties don't matter); an empty table gives an empty result; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 400, 200
#: Distinct contexts of an anchor up to which they meet in one suffix array.
HOT = 20_000
SHARD_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
KEY = "key bigint, bytes bigint"


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def _prefix(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(len(raw))[0], out=out[1:])
    return out


def contexts(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """text number, anchor hash, context hash, first and last start (in the text) of each context."""
    window = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return (none,) * 5
    h, inverse = _prefix(raw), _power(len(raw) + 1)[1]
    grams = common.mix((h[gram:] - h[:-gram]) * inverse[: len(raw) - gram + 1])
    low = np.uint64((1 << 24) - 1)
    packed = (grams & ~low) | (low - (np.arange(len(grams), dtype=np.uint64) & low))
    # Least of every window: from block starts forwards and from block ends backwards.
    padded = np.full(-(-len(packed) // window) * window, ~np.uint64(0))
    padded[: len(packed)] = packed
    rows = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(raw) - length + 1
    starts = np.arange(n)
    least = np.minimum(back[:n], ahead[window - 1 : window - 1 + n])
    place = (low - (least & low)).astype(np.int64)
    place += (starts - place + int(low)) // (1 << 24) * (1 << 24) if n > 1 << 24 else 0
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    good = starts + length <= at[text + 1]
    starts, place, text = starts[good], place[good], text[good]
    if not len(starts):
        return (none,) * 5
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = starts[new]
    last = np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1])
    whole = common.mix((h[last + length] - h[first]) * inverse[first] + (last - first).astype(np.uint64))
    text = text[new]
    return text, grams[place[new]].view(np.int64), whole.view(np.int64), first - at[text], last - at[text]


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of numbers below ``size``; the last one is 0 and nothing else is."""
    n = len(text)
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    induce = _induce if size * 32 <= n else _induce_thin
    # Types: True for suffixes smaller than the next one.
    change = np.flatnonzero(text[:-1] != text[1:])
    follow = change[np.minimum(np.searchsorted(change, np.arange(n - 1)), len(change) - 1)]
    small = np.append(text[follow] < text[follow + 1], True)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    begins = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
    # Leftmost-smaller substrings in order, by inducing from them unsorted.
    order = induce(text, small, begins, leftmost[np.argsort(text[leftmost].astype(np.uint16) if size <= 1 << 16 else text[leftmost], kind="stable")])
    is_left = np.zeros(n, bool)
    is_left[leftmost] = True
    order = order[is_left[order]]
    # Equal substrings get one name.
    number = np.zeros(n, np.int64)
    number[leftmost] = np.arange(len(leftmost))
    length = np.append(np.diff(leftmost) + 1, 1)[number[order]]
    same = np.zeros(len(order), bool)
    same[1:] = length[1:] == length[:-1]
    alive, k = np.flatnonzero(same), 0
    while len(alive):  # compare place by place; most differ at once
        ended = k >= length[alive]
        differ = ~ended & (text[np.minimum(order[alive] + k, n - 1)] != text[np.minimum(order[alive - 1] + k, n - 1)])
        same[alive[differ]] = False
        alive = alive[~ended & ~differ]
        k += 1
    names = np.cumsum(~same) - 1
    reduced = np.empty(len(order), np.int64)
    reduced[number[order]] = names
    if names[-1] + 1 == len(order):
        ranked = leftmost[np.argsort(reduced, kind="stable")]
    else:
        ranked = leftmost[suffix_array(reduced, int(names[-1]) + 1)]
    return induce(text, small, begins, ranked)


def _induce(text: np.ndarray, small: np.ndarray, begins: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The suffix array from the leftmost-smaller suffixes in order, a bucket at a time."""
    size = len(begins) - 1
    out = np.full(len(text), -1, np.int64)
    firsts = text[leftmost]
    cut = np.searchsorted(firsts, np.arange(size + 1))
    head = begins[:-1].copy()

    def spread(found: np.ndarray, step: int) -> None:
        """Put suffixes at the heads (1) or tails (-1) of their buckets, in this order."""
        chars = text[found]
        order = np.argsort(chars.astype(np.uint16) if size <= 1 << 16 else chars, kind="stable")  # short numbers sort by radix
        chars, found = chars[order], found[order]
        new = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
        counts = np.diff(np.append(new, len(chars)))
        rank = np.arange(len(chars)) - np.repeat(new, counts)
        out[head[chars] + step * rank] = found
        head[chars[new]] += step * counts

    for c in range(size):
        if begins[c] == begins[c + 1]:
            continue
        front = out[begins[c] : head[c]]
        while len(front):
            front = front[front > 0] - 1
            front = front[(text[front] == c) & ~small[front]]
            out[head[c] : head[c] + len(front)] = front
            head[c] += len(front)
        found = np.concatenate([out[begins[c] : head[c]], leftmost[cut[c] : cut[c + 1]]])
        found = found[found > 0] - 1
        found = found[~small[found] & (text[found] > c)]
        if len(found):
            spread(found, 1)
    larges = head.copy()
    head = begins[1:] - 1
    for c in range(size - 1, -1, -1):
        if begins[c] == begins[c + 1]:
            continue
        front = out[head[c] + 1 : begins[c + 1]][::-1]
        while len(front):
            front = front[front > 0] - 1
            front = front[(text[front] == c) & small[front]]
            out[head[c] - len(front) + 1 : head[c] + 1] = front[::-1]
            head[c] -= len(front)
        found = np.concatenate([out[begins[c] : larges[c]], out[head[c] + 1 : begins[c + 1]]])[::-1]
        found = found[found > 0] - 1
        found = found[small[found] & (text[found] < c)]
        if len(found):
            spread(found, -1)
    out[0] = len(text) - 1
    return out


def _induce_thin(text: np.ndarray, small: np.ndarray, begins: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The same where buckets hold few suffixes each, as in the recursion: a suffix at a time."""
    chars, smaller, bounds = text.tolist(), small.tolist(), begins.tolist()
    out, tail = [-1] * len(chars), bounds[1:]
    for i in reversed(leftmost.tolist()):
        tail[chars[i]] -= 1
        out[tail[chars[i]]] = i
    head = bounds[:-1]
    for k in range(len(out)):
        i = out[k] - 1
        if i >= 0 and not smaller[i]:
            c = chars[i]
            out[head[c]] = i
            head[c] += 1
    tail = bounds[1:]
    for k in range(len(out) - 1, -1, -1):
        i = out[k] - 1
        if i >= 0 and smaller[i]:
            c = chars[i]
            tail[c] -= 1
            out[tail[c]] = i
    return np.array(out, np.int64)


def common_prefixes(raw: np.ndarray, before: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each place, in text order, bytes shared with the suffix before it."""
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(most + 8, np.uint8)]), 8)
    out = np.zeros(len(places), np.int64)
    alive = np.arange(len(places))
    for k in range(0, most, 8):
        a, b = words[places[alive] + k], words[before[alive] + k]
        same = a == b
        full = same.all(axis=1)
        out[alive] += np.where(full, 8, same.argmin(axis=1))
        alive = alive[full]
        if not len(alive):
            break
    return np.minimum(out, most)


def repeated(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context which of its starts (all with ``length`` bytes behind) begin a string that
    begins elsewhere too."""
    sizes = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    text = raw.astype(np.int64) + 2
    text[ends] = 1
    valid = np.zeros(len(raw), bool)
    for i, n in zip(begins.tolist(), (sizes - length + 1).tolist(), strict=True):
        valid[i : i + n] = True
    order = suffix_array(np.append(text, 0), 258)[1:]
    order = order[valid[order]]
    hit = np.zeros(len(raw), bool)
    places = np.sort(order[1:])
    phi = np.zeros(len(raw), np.int64)
    phi[order[1:]] = order[:-1]
    long = common_prefixes(raw, phi[places], places, length) >= length
    hit[places[long]] = True
    hit[phi[places[long]]] = True
    return [hit[i : i + n] for i, n in zip(begins.tolist(), (sizes - length + 1).tolist(), strict=True)]


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges[::2].tolist(), (edges[1::2] - 1).tolist()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"key": F.xxhash64(F.coalesce("text", F.lit(""))), "bytes": F.octet_length(F.coalesce("text", F.lit(""))).cast("long")})


def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in common.blocks(b.column(2)):
                text, anchor, whole, first, last = contexts(*common.utf8(b.column(2).slice(i, j - i)), length, gram)
                rows = pa.array(text + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(anchor, pa.int64()), pa.array(whole, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["key", "bytes", "anchor", "whole", "first", "last"])

    return common.map_batches(_keyed(docs).where(f"bytes >= {length}").select("key", "bytes", "text"), work, f"{KEY}, anchor bigint, whole bigint, first int, last int")


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """key, bytes, first and last of runs of starts whose strings begin elsewhere too."""
    made: list[str] = []
    found = common.stage(_occurrences(docs, length, gram), made)
    twice = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b")).where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed"))
    twice = common.stage(twice, made)  # a table of its own, so that a join with a hot anchor can be split
    found = common.stage(found.join(twice.hint("merge"), "anchor"))
    for path in made:
        common.remove(docs.sparkSession, path)
    settled = found.where("NOT mixed").select("key", "bytes", "first", "last").distinct()
    row = F.struct("key", "bytes", "first", "last")
    open_ = common.stage(found.where("mixed").groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(row).alias("one")).select("anchor", "whole", "n", "one.*"))
    copies = found.where("mixed").join(open_.where("n > 1").select("anchor", "whole"), ["anchor", "whole"], "left_semi").select("key", "bytes", "first", "last").distinct()
    sizes = open_.groupBy("anchor").agg(F.count("*").alias("distinct_contexts"))
    large = common.stage(sizes.where(f"distinct_contexts > {hot}").select("anchor"))
    sides = [open_.join(common.small(large), "anchor", "left_anti"), None]
    if not large.isEmpty():
        sides[1] = open_.join(common.small(large), "anchor", "left_semi")

    def cut(side: DataFrame) -> DataFrame:
        """Contexts with their bytes: anchor, n, key, bytes, first, data."""
        wanted = common.stage(side.groupBy("key", "bytes").agg(F.collect_list(F.struct("anchor", "n", "first", "last")).alias("own")))
        d = _keyed(docs).where(f"bytes >= {length}").join(wanted.hint("merge"), ["key", "bytes"]).select("key", "bytes", "text", "own")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, data = [], []
                for k, n, t, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    raw = t.encode()
                    for c in own:
                        rows.append((c["anchor"], c["n"], k, n, c["first"]))
                        data.append(raw[c["first"] : c["last"] + length])
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(data, pa.binary())], ["anchor", "n", "key", "bytes", "first", "data"])

        return common.map_batches(d, work, f"anchor bigint, n bigint, {KEY}, first int, data binary")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: dict) -> pa.RecordBatch:
            rows = list(rows.values())
            out = []
            for (n, key, size, first, _), mask in zip(rows, repeated([r[4] for r in rows], length) if rows else [], strict=True):
                if n == 1:  # contexts that occur twice are settled already
                    out += [(key, size, first + i, first + j) for i, j in zip(*_runs(mask), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["key", "bytes", "first", "last"])

        held, size, last = {}, 0, None
        for b in batches:
            for anchor, n, key, total, first, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if anchor != last and size >= SHARD_BYTES:
                    yield flush(held)
                    held, size = {}, 0
                last = anchor
                # Copies of a text bring the same context more than once.
                held[anchor, key, total, first] = (n, key, total, first, data)
                size += len(data)
        yield flush(held)

    sharded = cut(sides[0]).repartition("anchor").sortWithinPartitions("anchor")
    out = [settled, copies, common.map_batches(sharded, sort, f"{KEY}, first int, last int")]
    if sides[1] is not None:

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    raw = np.frombuffer(b.column(5)[i].as_py(), np.uint8)
                    h, inverse = _prefix(raw), _power(len(raw) + 1)[1]
                    n = len(raw) - length + 1
                    hashes = common.mix((h[length:] - h[:-length]) * inverse[:n]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*(pa.array([b.column(c)[i].as_py()] * n, pa.int64()) for c in (2, 3)), pa.array(b.column(4)[i].as_py() + np.arange(n), pa.int32()), pa.array(hashes)], ["key", "bytes", "start", "string"])

        starts = common.stage(common.map_batches(cut(sides[1]), each, f"{KEY}, start int, string bigint").distinct())
        again = starts.groupBy("string").agg(F.count("*").alias("c")).where("c > 1").select("string")
        out.append(starts.join(again, "string", "left_semi").select("key", "bytes", F.col("start").alias("first"), F.col("start").alias("last")))
    total = out[0]
    for x in out[1:]:
        total = total.unionAll(x)
    return total


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """key, bytes and the maximal removed runs (begin, end) of the texts that lose any."""
    runs = repeated_starts(docs, length, gram, hot).groupBy("key", "bytes").agg(F.array_sort(F.collect_set(F.struct("first", (F.col("last") + length).alias("end")))).alias("r"))
    # Sorted runs that touch or overlap become one; the state holds the finished ones and the open one.
    kind = "array<struct<first:int,end:int>>"
    merged = F.aggregate(
        "r",
        F.array().cast(kind),
        lambda s, x: F.when((F.size(s) > 0) & (F.element_at(s, -1)["end"] >= x["first"]), F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(F.element_at(s, -1)["first"].alias("first"), F.greatest(F.element_at(s, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(s, F.array(x))),
    )
    return runs.select("key", "bytes", merged.cast(kind).alias("spans"))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, digests: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (or the kept bytes) of every row, and
    ``text``, the kept bytes as text; halves of characters at the edges of what went are left out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = common.stage(spans(docs, length, gram, hot))
    d = _keyed(docs.select("doc_id", "text")).join(found.hint("merge"), ["key", "bytes"], "left").select("doc_id", "text", "spans")
    last = "kept_sha256 string" if digests else "kept binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, kept, at = (t or "").encode(), [], 0
                for x in s or ():
                    kept.append(raw[at : x["first"]])
                    at = x["end"]
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(s or ()), sha256(kept).hexdigest() if digests else kept, None if t is None else kept.decode(errors="ignore") if s else t))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string() if digests else pa.binary()), pa.array(cols[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0], "text"])

    return common.map_batches(d, work, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, {last}, text string")
