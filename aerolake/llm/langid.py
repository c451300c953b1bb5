"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords (runs of 3 and 4 bytes inside its words, with
the words' edges). Stochastic gradient descent in numpy fits embeddings and softmax on a sample of
labelled rows, of SAMPLE rows at most in expectation, spread over the languages; a part held back
from the fit sets the temperature of the scores and the score under which a prediction is rejected.
As the softmax is linear, a prediction needs only one table of logits for each bucket.

Cases: a null text or one without a letter gets ``und`` and score 0; so does every row if no labelled
row can be learned from; null ``lang`` is never learned; of equally likely languages the first by name is
taken; very long texts count whole; repeated rows stay; an empty table gives an empty result; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS, DIM = 15, 16
SAMPLE = 4000
FEWEST = 50
EPOCHS, BATCH, RATE = 6, 64, 20.0
#: Share of the sample that is held back, and the share of right ones wanted among accepted rows.
HELD, PRECISION = 0.2, 0.99
_LETTER = common._WORD & ~np.isin(np.arange(256), np.arange(48, 58))


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of each text in order, and where each text's begin."""
    raw, at = common.utf8(texts)
    low = np.insert(common._LOWER[raw], at, 0)  # an edge before each text and after the last
    at = at + np.arange(len(at))
    letter = _LETTER[low]
    low = np.where(letter, low, 0).astype(np.uint32)
    found, places = [], []
    for n in (3, 4):
        inner = letter[1 : len(low) - n + 2].copy()
        for k in range(2, n - 1):
            inner &= letter[k : len(low) - n + 1 + k]
        where = np.flatnonzero(inner)
        packed = np.zeros(len(where), np.uint32)
        for k in range(n):
            packed = packed << np.uint32(8) | low[where + k]
        found.append((packed * np.uint32(2654435769) + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS))
        places.append(where)
    where = np.concatenate(places)
    order = np.argsort(where, kind="stable")
    return np.concatenate(found)[order].astype(np.int32), np.searchsorted(where[order], at)


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # by bucket and language
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def raw(self, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logits of each text."""
        n = np.diff(at)
        out = np.zeros((len(n), len(self.langs)), np.float32)
        if len(buckets):
            got, full = self.logits[buckets], np.flatnonzero(n)
            out[full] = np.add.reduceat(got, at[:-1][full], axis=0) / n[full, None]
        return out + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of the best language of each text, and its score."""
        best, score = [], []
        for i, j in common.blocks(texts, 1 << 18):
            p = self.scores(self.raw(*subwords(texts.slice(i, j - i))))
            best.append(p.argmax(axis=1))
            score.append(p.max(axis=1))
        return (np.concatenate(best), np.concatenate(score)) if best else (np.zeros(0, np.int64), np.zeros(0))


def fit(langs: list[str], labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], seed: int = 1) -> Model:
    """rows: distinct buckets of each text and their shares; labels: the number of its language."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, learned = order[: int(len(rows) * HELD)], order[int(len(rows) * HELD) :]
    emb = rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    weight = len(labels) / (len(langs) * np.maximum(np.bincount(labels, minlength=len(langs)), 1))

    def dense(part: np.ndarray) -> np.ndarray:
        x = np.zeros((len(part), 1 << BITS), np.float32)
        for k, r in enumerate(part):
            x[k, rows[r][0]] = rows[r][1]
        return x

    steps = EPOCHS * -(-len(learned) // BATCH)
    done = 0
    for _ in range(EPOCHS):
        rng.shuffle(learned)
        for k in range(0, len(learned), BATCH):
            part = learned[k : k + BATCH]
            x, y = dense(part), labels[part]
            h = x @ emb
            z = h @ out + bias
            g = np.exp(z - z.max(axis=1, keepdims=True))
            g /= g.sum(axis=1, keepdims=True)
            g[np.arange(len(y)), y] -= 1
            g *= (weight[y] / len(y))[:, None]
            rate = RATE * (1 - done / steps)
            back = g @ out.T
            out -= np.float32(rate) * (h.T @ g)
            bias -= np.float32(rate / 50) * g.sum(axis=0)
            emb -= np.float32(rate) * (x.T @ back)
            done += 1
    model = Model(langs, emb @ out, bias)
    if len(held):
        z, y = np.concatenate([dense(held[k : k + 256]) @ model.logits for k in range(0, len(held), 256)]) + bias, labels[held]

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(np.maximum(model.scores(z)[np.arange(len(y)), y], 1e-12)).mean()

        model.temperature = min((0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=loss)
        p = model.scores(z)
        right, score = p.argmax(axis=1) == y, p.max(axis=1)
        order = np.argsort(-score)
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION)
        model.reject_below = float(score[order[good[-1]]]) if len(good) else 1.0
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from labelled rows that aren't held out; the sample has ``sample`` rows in expectation."""
    d = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    most = max(FEWEST, sample // len(langs))
    chance = F.create_map(*[F.lit(x) for k in langs for x in (k, int(1e6 * min(1.0, most / counts[k])))])
    d = d.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < F.element_at(chance, F.col("lang")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, counted = [], []
            for i in range(b.num_rows):
                found, n = np.unique(subwords(b.column(1).slice(i, 1))[0], return_counts=True)
                own.append(found)
                counted.append((n / max(1, n.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int32())), pa.array(counted, pa.list_(pa.float32()))], ["lang", "found", "share"])

    got = common.map_batches(d.select("lang", "text"), features, "lang string, found array<int>, share array<float>").toArrow()
    labels = np.array([langs.index(x) for x in got["lang"].to_pylist()], np.int64)
    rows = [(np.array(f, np.int64), np.array(s, np.float32)) for f, s in zip(got["found"].to_pylist(), got["share"].to_pylist(), strict=True)]
    return fit(langs, labels, rows) if rows else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted (score not under the calibrated limit)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            known = np.array(b.column(2).to_pylist(), bool) & (m is not None)
            best, score = m.predict(b.column(3)) if m else (np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows))
            langs = [m.langs[k] if ok else "und" for k, ok in zip(best.tolist(), known, strict=True)]
            score = np.where(known, score, 0.0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(score), pa.array(known & (score >= (m.reject_below if m else 0)))], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"), "text")
    return common.map_batches(d, work, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")
