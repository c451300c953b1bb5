"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (toxic), 1 (plain) and 2 (good). One weight vector over hashed features is shared by all
grades, ordered thresholds part them: P(grade <= k) = sigmoid(threshold_k - weights . x). Features are
the words of a text and their stems (the first STEMS characters of longer words, so that the forms of
a word share one), each with its count over the root of the number of words. A feature needs a share
of the rated texts of one grade at least; an L1 penalty takes the weight of those that tell nothing.
The fit is on all labelled rows but a part held back by a hash of the id: features of the rows are
staged, Spark adds up the loss and its slopes in each pass, and the driver, which holds only the weights of
features, takes quasi-Newton steps (OWL-QN). All rows held back set the tail probability P(grade > 0) that a
document needs to be selected, so that the selection costs LOSS of the good ones (an exact quantile). Prediction gives the
expected grade, the tail probabilities and the selection.

Cases: null or empty texts have no word and get the grade of the thresholds alone; labels whose
document is missing are not learned from, nor labels with a null; if no label is left every row has
null predictions and is kept; if all labels are held back they are learned from as well; very long texts count whole; a document at the limit itself is kept; repeated
rows stay; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.operators import places

from . import common

BITS = 19
#: Lengths in characters of the stems of words longer than them.
STEMS = (4, 5, 6, 7)
#: Passes over the rows at most, and the gain of a pass, as a share of the loss, that ends them earlier.
PASSES, TOLERANCE, MEMORY, PENALTY = 40, 1e-5, 8, 1e-3
#: Sums over rows are of multiples of 1 / STEP.
STEP = float(1 << 26)
#: Share of the rated texts of a grade that must hold a feature, and their least number.
MIN_SHARE, MIN_TEXTS = 0.005, 3
HELD, LOSS = 0.25, 0.01
GRADES = 3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each text's words and stems, what each counts, and where each text's begin."""
    low, starts, inside, at = common.words(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(at))
    hashes, owners = [common.hash_runs(low, starts, inside) if len(starts) else np.zeros(0, np.uint64)], [owner]
    if len(starts):
        begins = (low & 0xC0) != 0x80  # of characters
        place = np.cumsum(begins)
        place -= np.repeat(place[starts], np.diff(np.append(starts, len(low))))
        length = np.add.reduceat((begins & inside).astype(np.int64), starts)
        for k in STEMS:
            longer = length > k
            hashes.append(common.mix(common.hash_runs(low, starts, inside & (place < k))[longer] + np.uint64(k)))
            owners.append(owner[longer])
    keys = np.concatenate(owners) << np.uint64(BITS) | np.concatenate(hashes) >> np.uint64(64 - BITS)
    keys, counts = np.unique(keys, return_counts=True)
    value = counts / np.sqrt(np.diff(at))[(keys >> np.uint64(BITS)).astype(np.int64)]
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int32), value.astype(np.float32), np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(BITS))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _thresholds(theta: np.ndarray) -> np.ndarray:
    return np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending
    min_clean: float = 0.5

    def level(self, found: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, full = np.zeros(len(at) - 1), np.flatnonzero(np.diff(at))
        if len(found):
            out[full] = np.add.reduceat(self.weights[found] * value, at[:-1][full])
        return out

    def tails(self, level: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and threshold k."""
        return 1 - _sigmoid(self.thresholds[None, :] - level[:, None])


def gradient(found: np.ndarray, value: np.ndarray, at: np.ndarray, grades: np.ndarray, weight: np.ndarray, theta: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What these rows add to the sums of the loss, its slopes by theta and its slopes by w, in whole steps of 1 / STEP;
    sums of such numbers are exact, so they don't depend on how the rows are dealt out."""
    n, rows = len(grades), np.arange(len(grades))
    owner = np.repeat(rows, np.diff(at))
    level = np.bincount(owner, w[found] * value, minlength=n)
    cum = np.concatenate([np.zeros((n, 1)), _sigmoid(_thresholds(theta)[None, :] - level[:, None]), np.ones((n, 1))], axis=1)
    p = np.maximum(cum[rows, grades + 1] - cum[rows, grades], 1e-9)
    slope = cum * (1 - cum)
    up, down = weight * slope[rows, grades + 1] / p, weight * slope[rows, grades] / p  # d log p by the upper and lower threshold
    by_threshold = np.where(grades[:, None] == np.arange(GRADES - 1), -up[:, None], 0) + np.where(grades[:, None] - 1 == np.arange(GRADES - 1), down[:, None], 0)
    by_theta = [by_threshold.sum(axis=1), *(by_threshold[:, k:].sum(axis=1) * np.exp(theta[k]) for k in range(1, len(theta)))]
    rest = np.array([np.rint(x * STEP).sum() for x in (-weight * np.log(p), *by_theta)])
    return np.concatenate([rest, np.bincount(found, np.rint((up - down)[owner] * value * STEP), minlength=len(w))])


def descend(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The least loss plus ``penalty`` times absolute values, by limited-memory quasi-Newton steps within an orthant (OWL-QN)."""
    loss, slope = evaluate(x)
    total, passes, steps = loss + penalty @ np.abs(x), 1, []
    while passes < PASSES:
        steepest = np.where(x != 0, slope + penalty * np.sign(x), np.sign(slope) * np.maximum(np.abs(slope) - penalty, 0))
        if not steepest.any():
            break
        d, parts = -steepest, []
        for s, y in reversed(steps):
            parts.append(s @ d / (s @ y))
            d = d - parts[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), part in zip(steps, reversed(parts), strict=True):
            d = d + (part - y @ d / (s @ y)) * s
        d[(penalty > 0) & (d * steepest >= 0)] = 0
        side = np.where(x != 0, np.sign(x), -np.sign(steepest))
        length = 1.0 if steps else min(1.0, 1 / np.linalg.norm(steepest))
        while passes < PASSES:
            new = x + length * d
            new[(penalty > 0) & (new * side < 0)] = 0
            loss, new_slope = evaluate(new)
            passes += 1
            if loss + penalty @ np.abs(new) <= total + 1e-4 * (steepest @ (new - x)):
                break
            length /= 2
        else:
            break
        gain = total - loss - penalty @ np.abs(new)
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps[1 - MEMORY :], (s, y)]
        x, slope, total = new, new_slope, total - gain
        if gain < TOLERANCE * total:
            break
    return x


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: toxic documents 0, others 1 or 2 by their quality."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("toxic").isNotNull() & F.col("quality").isNotNull(), 1 + (F.col("quality") > 0).cast("int"))
    return labels.select("doc_id", grade.cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")


def shares(counts: dict[int, int], sample: int) -> dict[int, float]:
    """What part of each grade's rows makes an equal deal of the sample; small grades leave the rest to others."""
    out, left = {}, sample
    for k, (g, n) in enumerate(sorted(counts.items(), key=lambda x: x[1])):
        out[g] = min(1.0, left / (len(counts) - k) / n)
        left -= out[g] * n
    return out


def _numbers(b: pa.RecordBatch, column: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of byte strings, and where each row's begin."""
    lengths = pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(b.column(column).to_pylist()), kind), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _strings(x: np.ndarray, at: np.ndarray) -> pa.Array:
    """A column of byte strings from numbers and where each row's begin."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _featured(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """held, grade, weight and the features (as bytes) of all rated documents."""
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(1000)) < int(1000 * HELD)
    d = docs.select("doc_id", "text").join(common.small(common.stage(ratings)), "doc_id").select(held.alias("held"), "grade", "weight", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in common.blocks(b.column(3)):
                found, value, at = features(b.column(3).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), _strings(found, at), _strings(value, at)], ["held", "grade", "weight", "found", "value"])

    return common.map_batches(d, work, "held boolean, grade int, weight double, found binary, value binary")


def _supported(rows: DataFrame, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The features that enough texts of a grade hold, ascending, and the sums of their squares."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, squares = np.zeros((GRADES, 1 << BITS), np.int64), np.zeros(1 << BITS)
        for b in batches:
            (found, at), (value, _) = _numbers(b, 1, np.int32), _numbers(b, 2, np.float32)
            grade = np.repeat(b.column(0).to_numpy(), np.diff(at))
            for g in range(GRADES):
                texts[g] += np.bincount(found[grade == g], minlength=1 << BITS)
            squares += np.bincount(found, np.rint(value.astype(np.float64) ** 2 * STEP), minlength=1 << BITS)
        seen = np.flatnonzero(texts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *(pa.array(x[seen]) for x in texts), pa.array(squares[seen].astype(np.int64))], ["feature", *(f"n{g}" for g in range(GRADES)), "squares"])

    names = [*(f"n{g}" for g in range(GRADES)), "squares"]
    found = common.map_batches(rows.select("grade", "found", "value"), work, "feature int, " + ", ".join(f"{c} bigint" for c in names))
    enough = " OR ".join(f"n{g} >= {max(MIN_TEXTS, MIN_SHARE * n)}" for g, n in counts.items())
    got = found.groupBy("feature").agg(*(F.sum(c).alias(c) for c in names)).where(enough).select("feature", "squares").toArrow()
    feature, squares = (got[c].to_numpy() for c in ("feature", "squares"))
    order = np.argsort(feature)
    return feature[order], squares[order] / STEP


def _compact(rows: DataFrame, used: np.ndarray) -> DataFrame:
    """grade, weight and the features among ``used``, by their numbers in it."""
    places = np.full(1 << BITS, -1, np.int32)
    places[used] = np.arange(len(used))
    shared = rows.sparkSession.sparkContext.broadcast(places)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (found, at), (value, _) = _numbers(b, 2, np.int32), _numbers(b, 3, np.float32)
            found = shared.value[found]
            at = np.concatenate([[0], np.cumsum(found >= 0)])[at]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _strings(found[found >= 0], at), _strings(value[found >= 0], at)], ["grade", "weight", "found", "value"])

    return common.map_batches(rows.select("grade", "weight", "found", "value"), work, "grade int, weight double, found binary, value binary")


def _sums(rows: DataFrame, theta: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``gradient`` over all rows, added up by Spark."""
    shared = rows.sparkSession.sparkContext.broadcast((theta, w))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            (found, at), (value, _) = _numbers(b, 2, np.int32), _numbers(b, 3, np.float32)
            total = total + gradient(found, value, at, b.column(0).to_numpy(), b.column(1).to_numpy(), *shared.value)
        at = np.flatnonzero(total) if np.ndim(total) else []
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64) if len(at) else [], pa.int64())], ["at", "part"])

    got = common.map_batches(rows, work, "at int, part bigint").groupBy("at").agg(F.sum("part").alias("part")).toArrow()
    shared.destroy()
    out = np.zeros(len(theta) + len(w) + 1)
    out[got["at"].to_numpy()] = got["part"].to_numpy() / STEP
    return out


def fit(rows: DataFrame) -> Model:
    """The model of all rows (grade, weight, found, value), a staged table: each step of the descent is a pass over them."""
    share = {r["grade"]: (r["n"], r["weight"]) for r in rows.groupBy("grade").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()}
    weight = np.array([share.get(g, (0, 0.0))[1] for g in range(GRADES)])
    shares = np.clip(np.cumsum(weight)[:-1] / weight.sum(), 0.01, 0.99)
    # Thresholds as the first one and the logarithms of the steps after it, so they stay ordered.
    first = np.log(shares / (1 - shares))
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    used, squares = _supported(rows, {g: n for g, (n, _) in share.items()})
    # A coordinate's scale: the fourth root of a bound of its curvature, between none and a full Newton step.
    scale = np.concatenate([np.full(len(theta), 0.7), (np.maximum(squares / weight.sum(), 1e-12) / 4) ** 0.25])
    penalty = np.concatenate([np.zeros(len(theta)), np.full(len(used), PENALTY)]) / scale
    kept: list[str] = []
    compact = common.stage(_compact(rows, used), kept)

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        x = x / scale
        sums = _sums(compact, x[: len(theta)], x[len(theta) :]) / weight.sum()
        return sums[0], sums[1:] / scale

    x = descend(evaluate, np.concatenate([theta, np.zeros(len(used))]) * scale, penalty) / scale
    common.remove(rows.sparkSession, *kept)
    weights = np.zeros(1 << BITS)
    weights[used] = x[len(theta) :]
    return Model(weights, _thresholds(x[: len(theta)]))


def train(docs: DataFrame, ratings: DataFrame, sample: int | None = None) -> Model | None:
    """Learn from all rows (doc_id, grade). A ``sample`` asks for a quick model from so many rows in expectation, dealt
    equally to the grades and weighted back to their shares."""
    ratings = ratings.withColumn("weight", F.lit(1.0))
    if sample is not None:
        part = shares({r["grade"]: r["count"] for r in ratings.groupBy("grade").count().collect()}, sample)
        own = F.get(F.array(*[F.lit(part.get(g, 0.0)) for g in range(GRADES)]), F.col("grade"))
        picked = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < 1e6 * own
        ratings = ratings.where(picked).withColumn("weight", 1 / own)
    kept: list[str] = []
    rows = common.stage(_featured(docs, ratings), kept)
    held = {r["held"]: r["count"] for r in rows.groupBy("held").count().collect()}
    if not held:
        return None
    model = fit(rows.where("NOT held") if False in held else rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (found, at), (value, _) = _numbers(b, 0, np.int32), _numbers(b, 1, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.tails(shared.value.level(found, value, at))[:, 0])], ["p"])

    good = common.map_batches(rows.where(f"held AND grade = {GRADES - 1}").select("found", "value"), clean, "p double")
    limit = places.percentiles(common.stage(good), "p", [], [LOSS]).first()
    if limit and limit["q"] is not None:
        model.min_clean = float(limit["q"][0])
    common.remove(docs.sparkSession, *kept)
    return model


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, expected_grade, p_clean (grade above 0), p_good (the best grade), kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i, j in common.blocks(b.column(1)):
                part = b.column(1).slice(i, j - i)
                if m is None:
                    nothing = pa.nulls(j - i, pa.float64())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), nothing, nothing, nothing], ["doc_id", "expected_grade", "p_clean", "p_good"])
                    continue
                tails = m.tails(m.level(*features(part)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, -1])], ["doc_id", "expected_grade", "p_clean", "p_good"])

    out = common.map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, expected_grade double, p_clean double, p_good double")
    kept = F.coalesce(F.col("p_clean") >= F.lit(model.min_clean if model else None).cast("double"), F.lit(True))
    return out.withColumn("kept", kept)
