"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, overlap check.

Test items are indexed by word, with postings in item order and a bound for each word and block of
BLOCK items. Each document is a sequence of passages (half-overlapping windows of words, long enough
that every item lies inside one), and every passage is a query. Impacts are divided by an item's
score against itself, so one threshold serves all items: the share of its BM25 weight that a passage
holds. A numpy pass over whole batches adds up the block bounds of each passage; only blocks that can
reach the threshold run WAND, which returns every item above it. A hit then counts only if the
passage holds enough of the item's question and of its answer (its last sentence, or last quarter)
as word n-grams.

BM25's statistics (documents of a word, mean length) and the length of a passage are those of all items,
counted by Spark once, so a pair's score doesn't depend on how items are dealt out. The index is broadcast
in segments of SEGMENT items, which bounds the table of block bounds. At most ITEMS_PER_PASS items are
broadcast at once, a stated query set; a larger benchmark takes further passes over the documents, so
nothing broadcast grows with either table. Items of fewer than MIN_WORDS words carry too little weight for a
score and are searched exactly in the same pass, as a run of all their words.

Cases: null or empty texts hold nothing; items with a null text or under two words have no question and
answer, are skipped and reported by ``skipped_items``; items with a null id are searched and reported with
it; items with equal texts each match; of passages with equal scores the first counts; very long documents
are searched whole, half-overlapping passage by passage; repeated documents each report; no item or no
document gives an empty result; further columns of either table, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
THRESHOLD = 0.7
MIN_WORDS = 8
MIN_PASSAGE = 32
BLOCK = 8
SEGMENT = 2_000
ITEMS_PER_PASS = 10_000
GRAM = 5
MIN_QUESTION, MIN_ANSWER = 0.5, 0.5


def parts(text: str) -> tuple[str, str]:
    """Question and answer of an item: all but its last sentence and that, else by its words."""
    pieces = [x for x in re.findall(r"[^.?!\n]+[.?!\n]*", text) if x.strip()]
    if len(pieces) > 1:
        return "".join(pieces[:-1]), pieces[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Distinct hashes of the word n-grams; of all the words if there are fewer."""
    n = max(1, min(n, len(words)))
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        total = total * np.uint64(0xD1342543DE82EF95) + words[j : len(words) - n + 1 + j]
    return np.unique(total)


@dataclass
class Statistics:
    """Of all items of MIN_WORDS words and more: how many, their mean and greatest number of words, and
    how many hold each word (of those words that are asked for)."""

    items: int
    mean_length: float
    longest: int
    df: dict[int, int]


class Index:
    """Postings of the items' words with block bounds."""

    def __init__(self, items: list[tuple[int | None, str]], stats: Statistics, threshold: float = THRESHOLD):
        self.threshold, self.half = threshold, max(MIN_PASSAGE, stats.longest)
        self.ids, rows, self.parts, short = [], [], [], []
        for item, text in items:
            words = common.word_hashes(pa.array([text]))[0]
            if len(words) >= MIN_WORDS:
                self.ids.append(item)
                rows.append(words)
                self.parts.append([common.word_hashes(pa.array([x]))[0] for x in parts(text)])
            elif len(words) >= 2:
                short.append((item, words))
        # Short items by their number of words: hashes of the whole runs, ascending, and their numbers.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for _, w in short}):
            own = [(int(grams(w, n)[0]), len(self.ids) + k) for k, (_, w) in enumerate(short) if len(w) == n]
            self.short[n] = tuple(np.array(x, t) for x, t in zip(zip(*sorted(own), strict=True), (np.uint64, np.int64), strict=True))
        self.ids += [item for item, _ in short]
        words = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.terms, number = np.unique(words, return_inverse=True)
        key, tf = np.unique(number.astype(np.int64) * max(1, len(rows)) + owner, return_counts=True)
        term, self.items = key // max(1, len(rows)), key % max(1, len(rows))
        length = np.bincount(owner, minlength=len(rows)) if rows else np.zeros(0)
        df = np.array([stats.df[t] for t in self.terms.tolist()], float)
        # Words of more than half of the items weigh next to nothing.
        idf = np.maximum(np.log((stats.items - df + 0.5) / (df + 0.5)), 1e-3)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.items] / max(stats.mean_length, 1)))
        impact /= np.bincount(self.items, impact, minlength=len(rows))[self.items]
        self.impact = impact
        self.starts = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.bound = np.maximum.reduceat(impact, self.starts[:-1]) if len(impact) else np.zeros(0)
        self.blocks = np.zeros((len(self.terms), -(-len(rows) // BLOCK)), np.float32)
        np.maximum.at(self.blocks, (term, self.items // BLOCK), impact.astype(np.float32))

    def wand(self, terms: np.ndarray, block: int) -> list[tuple[int, float]]:
        """All items of a block whose score against these distinct terms reaches the threshold."""
        least, end = self.threshold - 1e-6, (block + 1) * BLOCK
        lists = []  # current item, term, place in its postings
        for t in terms[self.blocks[terms, block] > 0].tolist():
            at = int(self.starts[t] + np.searchsorted(self.items[self.starts[t] : self.starts[t + 1]], block * BLOCK))
            lists.append([int(self.items[at]), t, at])
        found = []
        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(lists):
                total += self.blocks[t, block]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            target = item
            if lists[0][0] == item:
                score = sum(self.impact[at] for i, _, at in lists if i == item)
                if score >= least:
                    found.append((item, float(score)))
                target = item + 1
            for x in lists:
                if x[0] < target:
                    x[2] += int(np.searchsorted(self.items[x[2] : self.starts[x[1] + 1]], target))
                    x[0] = int(self.items[x[2]]) if x[2] < self.starts[x[1] + 1] else end
            lists = [x for x in lists if x[0] < end]
        return found

    def search(self, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """(row, item number, score, question overlap, answer overlap) of verified hits, the best
        passage of each row and item."""
        words, at = common.word_hashes(texts)
        exact = self.exact(words, at)
        if not len(words) or not len(self.terms):
            return exact
        half = self.half
        slot = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[slot] == words)
        row = np.searchsorted(at, hit, "right") - 1
        # Halves of passages, numbered over all texts; a passage is two halves side by side.
        per = -(-np.diff(at) // half)
        first = np.concatenate([[0], np.cumsum(per)])
        own = first[row] + (hit - at[row]) // half
        keys = np.unique(own * len(self.terms) + slot[hit])
        in_half, term = keys // len(self.terms), keys % len(self.terms)
        cut = np.searchsorted(in_half, np.arange(first[-1] + 1))
        bound = np.zeros((first[-1] + 1, self.blocks.shape[1]), np.float32)
        some = np.flatnonzero(np.diff(cut))
        if len(some):
            bound[some] = np.add.reduceat(self.blocks[term], cut[:-1][some], axis=0)
        owner = np.repeat(np.arange(len(texts)), per)
        follows = np.append(owner[1:] == owner[:-1], False)
        total = bound[:-1] + np.where(follows[:, None], bound[1:], 0)
        best: dict[tuple[int, int], tuple] = {}
        for h, block in zip(*(x.tolist() for x in np.nonzero(total >= self.threshold - 1e-6)), strict=True):
            held = np.unique(term[cut[h] : cut[h + 1 + bool(follows[h])]])
            if not (hits := self.wand(held, block) if self.blocks[held, block].sum() >= self.threshold - 1e-6 else []):
                continue
            r = int(owner[h])
            i = int(at[r] + (h - first[r]) * half)
            passage = words[i : min(i + 2 * half, int(at[r + 1]))]
            for item, score in hits:
                q, a = (float(np.isin(grams(p), grams(passage, min(GRAM, len(p)))).mean()) if len(p) else 1.0 for p in self.parts[item])
                if q >= MIN_QUESTION and a >= MIN_ANSWER and score > best.get((r, item), (0.0,))[0]:
                    best[r, item] = (score, q, a)
        return [(r, item, *x) for (r, item), x in sorted(best.items())] + exact

    def exact(self, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(row, item number, 1, 1, 1) of the short items whose words stand in a row of a text."""
        found = set()
        for n, (runs, numbers) in self.short.items():
            if len(words) < n:
                continue
            total = np.zeros(len(words) - n + 1, np.uint64)
            for j in range(n):
                total = total * np.uint64(0xD1342543DE82EF95) + words[j : len(words) - n + 1 + j]
            first = np.searchsorted(runs, total)
            hit = np.flatnonzero(runs[np.minimum(first, len(runs) - 1)] == total)
            row = np.searchsorted(at, hit, "right") - 1
            for r, i in zip(row.tolist(), hit.tolist(), strict=True):
                k = int(first[i])
                while i + n <= at[r + 1] and k < len(runs) and runs[k] == total[i]:
                    found.add((r, int(numbers[k])))
                    k += 1
        return [(r, item, 1.0, 1.0, 1.0) for r, item in sorted(found)]


def skipped_items(benchmark: DataFrame) -> DataFrame:
    """Items that have no two words, or no text."""
    return benchmark.where(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"), 0)) < 2)


def item_words(items: DataFrame) -> DataFrame:
    """n (words of the item) and words (hashes of the distinct ones), with pass_no, of each item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = common.word_hashes(b.column(1))
            own = [np.unique(words[i:j]).view(np.int64) for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at), pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["pass_no", "n", "words"])

    return common.map_batches(items.select("pass_no", "text"), work, "pass_no bigint, n bigint, words array<bigint>").where(f"n >= {MIN_WORDS}")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every verified pair."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    arrow = docs.sparkSession.createDataFrame([], schema).toArrow().schema.field("item_id").type
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    if not (count := items.count()):
        return spark.createDataFrame([], schema)
    passes = -(-count // ITEMS_PER_PASS)
    items = items.withColumn("pass_no", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    counted = common.stage(item_words(items))
    many, mean, longest = counted.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(0.0)), F.coalesce(F.max("n"), F.lit(0))).first()
    words = counted.select("pass_no", F.explode("words").alias("word"))
    held = common.stage(words.groupBy("word").agg(F.count("*").alias("df")))
    found = []
    for k in range(passes):
        rows = sorted(((r["item_id"], r["text"]) for r in items.where(F.col("pass_no") == k).collect()), key=lambda r: (r[0] is None, r))
        own = held.join(words.where(F.col("pass_no") == k).select("word").distinct(), "word") if passes > 1 else held
        stats = Statistics(many, mean, longest, {r["word"] % (1 << 64): r["df"] for r in own.collect()})
        index = spark.sparkContext.broadcast([Index(rows[i : i + SEGMENT], stats, threshold) for i in range(0, len(rows), SEGMENT)])

        def work(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b, segment in ((b, x) for b in batches for x in index.value):
                for i, j in common.blocks(b.column(1)):
                    hits = segment.search(b.column(1).slice(i, j - i))
                    rows = pa.array([i + h[0] for h in hits], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([segment.ids[h[1]] for h in hits], arrow), *(pa.array([h[c] for h in hits], pa.float64()) for c in (2, 3, 4))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found.append(common.map_batches(docs.select("doc_id", "text"), work, schema))
    return reduce(DataFrame.unionAll, found)
