"""What the corpus operators share: reading tables, shipping the package, staging tables, and
word hashes of whole Arrow batches in numpy."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; with them a batch of very long texts stays in a worker's memory.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_corpus_shipped", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._corpus_shipped = sc.applicationId


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset a temporary one serves a local
    master; on a cluster it would lose rows, so that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(sc, "_corpus_dir", None) or Path(tempfile.mkdtemp(prefix="corpus-")).as_uri()
        sc._corpus_dir = base
    return f"{base.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged folder on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and a lost
    executor costs a read. The folder goes when the application ends; its path is appended to
    ``keep`` where the caller removes it earlier."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    if keep is None:
        atexit.register(_quietly, spark, path)
    else:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _quietly(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


#: Bytes of a table that may be broadcast; beyond them the join shuffles.
MOST_BROADCAST = 32 << 20


def width(df: DataFrame) -> Column:
    """About the bytes of a row in memory; arrays and strings by their sizes."""
    fixed, total = 24, F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif kind == "array":
            total = total + F.greatest(F.size(f"`{f.name}`"), F.lit(0)) * 16 * max(1, len(getattr(f.dataType.elementType, "fields", ())))
        fixed += 16 * max(1, len(getattr(f.dataType, "fields", ())))
    return (total + fixed).cast("long")


def small(df: DataFrame) -> DataFrame:
    """df, a staged table, marked for broadcast if it has few bytes, which are counted."""
    held = df.agg(F.coalesce(F.sum(width(df)), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= MOST_BROADCAST else df


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't among ids (one column, doc_id); null is an id as well."""
    gone = small(stage(ids.distinct())).withColumnRenamed("doc_id", "gone_id")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


def text_key() -> list[Column]:
    """128 bits of the text, in two columns."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with doc_id and text as a key in the place of doc_id, never null and ordered as the ids
    (null last), so that verdicts meet their own rows where ids are null or shared."""
    return docs.withColumn("doc_id", F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), *text_key()))


def unkeyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("doc_id.id"))


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package on the executors and batches of a bounded number of rows."""
    ship(df.sparkSession)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key, "10000")) > BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(work, schema)


# --- words of a batch, in numpy -------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (the usual xor-shift finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Factors of the bytes of a run by their place; those of further places are made when needed.
_FACTORS = [mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) + np.uint64(k << 40)) for k in range(2)]


def _factors(place: np.ndarray, k: int) -> np.ndarray:
    out = _FACTORS[k][place & 0xFFFF]
    if len(far := np.flatnonzero(place > 0xFFFF)):
        out[far] = mix(place[far].astype(np.uint64) + np.uint64((k << 40) + 1))
    return out


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each text begins (one more for the end); null: empty."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(texts: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes, each of one row at least."""
    _, at = utf8(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j
        i = j


def hash_runs(raw: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A hash, never 0, of each run of bytes from one start to the next; only bytes ``inside`` count."""
    return _hashed(raw, starts, inside, 1)[0]


def hash_pairs(raw: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each run, which name it together."""
    return _hashed(raw, starts, inside, 2)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes up to which a name is read eight at a time.
_SHORT = 64


def name_pairs(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes, never 0, of ``sizes`` bytes from each start and its flag ``inner``."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    mark = (sizes * 2 + inner).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, two = mark, ~mark
    for k in range(0, min(int(sizes.max(initial=1)), _SHORT), 8):
        there = slice(None) if not k else np.flatnonzero((sizes > k) & (sizes <= _SHORT))
        value = eight[starts[there] + k] & _MASKS[np.minimum(sizes[there] - k, 8)]
        one[there], two[there] = mix(one[there] ^ value), mix(two[there] + value * np.uint64(0xD1342543DE82EF95))
    if len(far := np.flatnonzero(sizes > _SHORT)):
        at = np.cumsum(sizes[far]) - sizes[far]
        data = raw[np.repeat(starts[far] - at, sizes[far]) + np.arange(sizes[far].sum())]
        for out, h in zip((one, two), hash_pairs(data, at, np.ones(len(data), bool)), strict=True):
            out[far] = mix(h + mark[far] if out is two else h ^ mark[far])
    for out in (one, two):
        out[out == 0] = 1
    return one, two


def _hashed(raw: np.ndarray, starts: np.ndarray, inside: np.ndarray, count: int) -> tuple[np.ndarray, ...]:
    """Sums of the bytes times a factor of their own for each place, however long the run."""
    place = np.arange(len(raw), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(raw))))
    value = raw.astype(np.uint64) + np.uint64(1)
    value[~inside] = 0
    out = []
    for k in range(count):
        h = mix(np.add.reduceat(value * _factors(place, k), starts))
        h[h == 0] = 1
        out.append(h)
    return tuple(out)


def segments(may_cut: np.ndarray, at: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of about ``size`` bytes that end where a text does or before a byte that ``may_cut``
    flags; longer ones only where no such byte comes."""
    lo, n = 0, len(may_cut)
    while lo < n:
        hi, step = lo, size
        while hi == lo:
            end = min(lo + step, n)
            if end == n:
                hi = n
            else:
                inner = np.flatnonzero(may_cut[lo + 1 : end + 1])
                hi = max(int(at[np.searchsorted(at, end, "right") - 1]), lo + 1 + int(inner[-1]) if len(inner) else lo)
            step *= 2
        yield lo, hi
        lo = hi


def word_starts(inside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where runs of True begin; a run ends where a text does."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    borders = at[1:-1]
    borders = borders[borders < len(inside)]
    begins[borders] = inside[borders]
    return np.flatnonzero(begins)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes from the first word on, where words begin in them, which bytes are inside words, and
    where each text's words begin (one more for the end). A word is a run of ASCII letters, digits and
    non-ASCII characters; ASCII and Latin-1 letters count as small ones."""
    raw, at = utf8(texts)
    low = _LOWER[raw]
    accents = np.flatnonzero(raw[:-1] == 0xC3) + 1
    accents = accents[(raw[accents] >= 0x80) & (raw[accents] <= 0x9E) & (raw[accents] != 0x97)]
    low[accents] += 32
    inside = _WORD[low]
    starts = word_starts(inside, at)
    if not len(starts):
        return low[:0], starts, inside[:0], np.zeros(len(at), np.int64)
    return low[starts[0] :], starts - starts[0], inside[starts[0] :], np.searchsorted(starts, at)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text in order, and where each text's words begin (one
    more for the end)."""
    low, starts, inside, at = words(texts)
    return hash_runs(low, starts, inside) if len(starts) else np.zeros(0, np.uint64), at


class HashTable:
    """Numbers 0, 1, ... for pairs of 64-bit hashes, open addressing in three arrays."""

    def __init__(self, size: int):
        self.bits = max(4, int(2 * size).bit_length())
        self.keys, self.checks = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.used = 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The number of each pair; -1 where it has none."""
        out = np.full(len(keys), -1, np.int32)
        left, slot = np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = (there == keys[left]) & (self.checks[slot] == checks[left])
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray) -> None:
        """Give distinct new pairs the next numbers."""
        values = np.arange(self.used, self.used + len(keys), dtype=np.int32)
        self.used += len(keys)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            # Of those that want a free slot one gets it, with both of its hashes.
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.checks[slot[free]], self.values[slot[free]] = keys[free], checks[free], values[free]
            lost = np.ones(len(keys), bool)
            lost[free] = False
            keys, checks, values, slot = keys[lost], checks[lost], values[lost], (slot[lost] + 1) & (len(self.keys) - 1)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs in the order of their numbers."""
        full = np.flatnonzero(self.keys)
        full = full[np.argsort(self.values[full])]
        return self.keys[full], self.checks[full]


def distinct_pairs(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where the first of each distinct pair stands, by key."""
    order = np.lexsort((checks, keys))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])
    return order[new]


class Ragged:
    """Runs of numbers in one growing array."""

    def __init__(self, kind: str = "<i4"):
        self.flat, self.starts, self.used, self.runs = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), 0, 0
        self.lengths = np.zeros(1 << 14, np.int32)

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.runs + len(lengths) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[self.runs : self.runs + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.runs : self.runs + len(lengths)] = lengths
        self.used += len(flat)
        self.runs += len(lengths)

    def gather(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these runs one after the other, and how many each has."""
        lengths = self.lengths[runs]
        ends = np.cumsum(lengths, dtype=np.int64)
        return self.flat[np.repeat(self.starts[runs] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each text in order, and where each text's runs begin. A
    text of 1 to n - 1 words has one run, all its words; a text without a word has none."""
    words, at = word_hashes(texts)
    counts = np.diff(at)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(runs)])
    start = np.repeat(at[:-1] - out[:-1], runs) + np.arange(out[-1])
    end = np.repeat(at[1:], runs)
    total = np.zeros(out[-1], np.uint64)
    for j in range(n):
        there = start + j < end
        total = total * np.uint64(0xD1342543DE82EF95) + np.where(there, words[np.minimum(start + j, max(len(words) - 1, 0))] if len(words) else np.uint64(0), np.uint64(j + 1))
    return mix(total), out
