"""Filter interaction audit: what each of five filters removes at every place of every order.

A document's failures are five bits. A table of 32 failure patterns by 120 orders says at which step an order removes
it, so no order is ever run: a task counts its documents by part, pattern and label (``np.bincount``), looks the
patterns up in the table and adds the counts to arrays of 120 x 5 cells for each part; the arrays of the tasks are
summed by Spark. Lengths, words, letters and signs are counted by DataFrame functions; whether a text has occurred
under a smaller doc_id is a join with the least doc_id of each text on text and doc_id together, so copies of a text
don't meet in a task.

Cases: a null text counts as empty, a null source is the part ''; rows of an equal doc_id and text are copies of no
smaller doc_id; a null doc_id is no smaller one, has none, and has no label; labels that repeat a doc_id count if
any of them says so; rows are counted one by one, also repeated ones; very long texts are counted whole; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
ORDERS = list(permutations(range(5)))
NAMES = ["".join(FILTERS[f] for f in order) for order in ORDERS]
#: FIRST[pattern, order]: the step, from 0, that removes a document; 5: none. Bit f of the pattern: it fails filter f.
FIRST = np.array([[next((step for step, f in enumerate(order) if p >> f & 1), 5) for order in ORDERS] for p in range(32)])
#: REDUNDANT[pattern, order, step]: it fails the filter of the step and is gone already. ALONE: it fails that one only.
REDUNDANT = np.array([[[p >> f & 1 and step > FIRST[p, k] for step, f in enumerate(order)] for k, order in enumerate(ORDERS)] for p in range(32)], np.int64)
ALONE = np.array([[[p == 1 << f for f in order] for order in ORDERS] for p in range(32)], np.int64)
CELLS = 120 * 5
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts whose counts a task holds before it gives them on.
MOST_PARTS = 2000
BLANK = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(docs: DataFrame) -> DataFrame:
    """part, doc_id, h1, h2 (of the text) and ``bits`` of the filters A to D, for each row of docs."""
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumns({"words": F.array_remove(F.split("text", BLANK), ""), "plain": F.regexp_replace("text", "[^A-Z]+", "")})
    d = d.withColumns({"n": F.size("words").cast("long"), "distinct": F.size(F.array_distinct("words")).cast("long")})
    fails = [F.col("n") < 200, 100 * F.col("distinct") < 50 * F.col("n"), 100 * F.char_length("plain").cast("long") > 2 * F.char_length("text").cast("long"), F.col("text").rlike(r"[#$%&*|]")]
    bits = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))
    return d.select("part", "doc_id", *common.text_key(), bits.alias("bits"))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, pattern (0 to 31) and label (1: good, 2: toxic, 3: both) of each document."""
    d = common.stage(failures(docs))
    first = d.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    mark = lambda c, k: F.max(F.when(F.col(c) == 1, k).otherwise(0))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((mark("quality", 1) + mark("toxic", 2)).alias("label")).where("label > 0")
    d = d.join(first, ["h1", "h2", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    return d.select("part", (F.col("bits") + copy).alias("pattern"), F.coalesce("label", F.lit(0)).alias("label"))


def arrays(counts: np.ndarray) -> np.ndarray:
    """(7 measures, 120 x 5 cells) of counts[pattern, label]."""
    def by_first(weights: np.ndarray) -> np.ndarray:
        cell = np.arange(120) * 6 + FIRST  # one more step for what stays
        return np.bincount(cell.ravel(), np.repeat(weights, 120), 720).reshape(120, 6).astype(np.int64)

    per, good, toxic = counts.sum(axis=1), counts[:, [1, 3]].sum(axis=1), counts[:, [2, 3]].sum(axis=1)
    gone = by_first(per)
    kept = per.sum() - np.cumsum(gone[:, :5], axis=1)
    shapley = np.bincount(np.array(ORDERS).ravel(), gone[:, :5].ravel(), 5).astype(np.int64)[np.array(ORDERS)]
    cells = [kept, gone[:, :5], np.tensordot(per, REDUNDANT, 1), np.tensordot(per, ALONE, 1), by_first(good)[:, :5], by_first(toxic)[:, :5], shapley]
    return np.stack([x.reshape(CELLS) for x in cells])


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of arrays for each part of a task's rows (more than one beyond MOST_PARTS parts)."""
    held: dict[str, np.ndarray] = {}

    def given() -> Iterator[pa.RecordBatch]:
        names = list(held)
        for i in range(0, len(names), 50):
            some = names[i : i + 50]
            sums = [arrays(held[x]) for x in some]
            flat = [pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * CELLS), pa.array(np.concatenate([s[k] for s in sums]))) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *flat], names=["part", *MEASURES])
        held.clear()

    for b in batches:
        parts = b.column(0).dictionary_encode()
        code = (parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 32 + b.column(1).to_numpy(zero_copy_only=False)) * 4 + b.column(2).to_numpy(zero_copy_only=False)
        names = parts.dictionary.to_pylist()
        counts = np.bincount(code, minlength=len(names) * 128).reshape(len(names), 32, 4)
        for name, c in zip(names, counts, strict=True):
            held[name] = held[name] + c if name in held else c
        if len(held) > MOST_PARTS:
            yield from given()
    yield from given()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step (1 to 5), and the seven measures, for every part, order and step."""
    schema = ", ".join(["part string", *(f"{m} array<bigint>" for m in MEASURES)])
    d = common.map_batches(audited(docs, labels).select("part", F.col("pattern").cast("long"), F.col("label").cast("long")), count, schema)
    d = d.select("part", F.posexplode(F.arrays_zip(*MEASURES)).alias("cell", "x")).groupBy("part", "cell").agg(*(F.sum(f"x.{m}").alias(m) for m in MEASURES))
    order = F.get(F.lit(NAMES), F.floor(F.col("cell") / 5).cast("int"))
    return d.select("part", order.alias("filter_order"), (F.col("cell") % 5 + 1).cast("int").alias("step"), *MEASURES)


#: Every order run over the documents.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
b AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > first, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM b LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) v(name, i)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p, a.name || b.name || c.name || d.name || e.name AS filter_order
    FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, p, step, p[step] AS f FROM o, range(1, 6) t(step)),
m AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, f,
    CAST(sum(CASE WHEN len(list_filter(p[1:step], lambda x: fails[x])) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN fails[f] AND len(list_filter(p[1:step - 1], lambda x: fails[x])) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN fails[f] AND len(list_filter(p[1:step - 1], lambda x: fails[x])) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails[f] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN fails[f] AND len(list_filter(p[1:step - 1], lambda x: fails[x])) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN fails[f] AND len(list_filter(p[1:step - 1], lambda x: fails[x])) = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM g, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM m"""
