"""Training-order files of token ids: a keyed permutation gives every sequence its global slot.

A document's ids and an end mark are cut into sequences of ``length`` ids, the last one padded.
Sequences count from 0 in the order of the input (file, row, part), whatever the tasks that read
it: each task numbers the sequences of its own rows of a file, and these runs, named by the task and their
number in it, get offsets from a table with one row for each. A keyed Feistel network over the smallest fitting power of four, walked on until
it falls below the number of sequences, maps that number to the slot. Slots are dealt to shards by
range, sorted and written as records of one stride: ``length`` little-endian 16-bit ids and a closing
end mark. Spark's own writer makes the files, so they may lie on any store and survive lost tasks.

Cases: a null text counts as empty; an empty text is one sequence with just the end mark; repeated
rows and ids are sequences of their own; an empty table gives no shard and an empty result; an input
that isn't a plain scan of files (projections and filters aside) is staged and counts in the order of its partitions, and
a path that is read twice gives every sequence twice; very long texts are cut in
segments and their sequences follow each other before the permutation; slots are all different, so there
are no ties; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_counts import MODEL, Pieces

LENGTH = 256
#: Sequences of a shard, and the most shards; beyond them shards grow with the input.
PER_SHARD, MOST_SHARDS = 1 << 16, 50_000
KEY = "training order"
ROUNDS = 6
#: </s> of the model; it closes documents, fills up sequences and ends records.
END = 2
#: The runs table is broadcast up to this many rows (one for each task of the scan), else joined.
MOST_RUNS = 200_000
#: Pre-tokens of a worker's cache.
CACHE_SIZE = 1_600_000


def slots(index: np.ndarray, total: int, key: str = KEY) -> np.ndarray:
    """The keyed permutation of 0..total-1 at ``index``."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.frombuffer(blake2b(key.encode(), digest_size=8 * ROUNDS).digest(), "<u8")
    out = index.astype(np.uint64)
    left = np.arange(len(out))
    while len(left):
        hi, lo = out[left] >> shift, out[left] & mask
        for k in keys:
            hi, lo = lo, hi ^ (common.mix(lo ^ k) & mask)
        out[left] = hi << shift | lo
        left = left[out[left] >= total]
    return out.astype(np.int64)


_workers: dict[str, Pieces] = {}


def _pieces(model: str) -> Pieces:
    """A worker's cache, which serves its tasks of both passes. A function of the module finds it; what a task's own
    function names is sent with it and would be new in each task."""
    if (pieces := _workers.get(model)) is None:
        pieces = _workers[model] = Pieces(model, keep_ids=True, cache=CACHE_SIZE)
    return pieces


def _plain(docs: DataFrame) -> bool:
    """Whether docs are rows of files as a scan gives them, the same in the same order at every reading."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and the place of each row; what isn't read from files is staged first."""
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    if _plain(docs):
        try:
            return docs.select("doc_id", "text", *place)
        except AnalysisException:  # a source without row numbers
            pass
    return common.stage(docs.select("doc_id", "text")).select("doc_id", "text", *place)


def sequences(rows: DataFrame, tokens: bool, model: str = MODEL, length: int = LENGTH) -> DataFrame:
    """task, piece (the number of a run in its task) and local (a sequence's number in its run), with the tokens of each
    sequence or with its doc_id, part and n_tokens and with run_file and run_row, where the run begins."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        if pieces.sp.get_piece_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits don't fit the records")
        task, piece = TaskContext.get().partitionId(), -1
        run, last, local = ("", 0), ("", -2), 0
        for b in batches:
            for i, j in common.blocks(b.column(1)):
                texts = b.column(1).slice(i, j - i)
                if tokens:
                    ids, at = pieces.stream(texts, END)
                else:
                    at = np.concatenate([[0], np.cumsum(pieces.counts(texts) + 1)])
                per = -(-np.diff(at) // length)
                owner = np.repeat(np.arange(j - i), per)
                part = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
                starts = at[owner] + part * length
                ends = np.minimum(starts + length, at[owner + 1])
                place = zip(b.column(2).slice(i, j - i).to_pylist(), b.column(3).slice(i, j - i).to_pylist(), strict=True)
                run_of, firsts = np.empty((4, j - i), np.int64), [run[0]]  # of each row: where in firsts its run's file is, the run's row, piece, and number of its first sequence
                for k, ((f, r), n) in enumerate(zip(place, per.tolist(), strict=True)):
                    if f != last[0] or r <= last[1]:  # gaps (rows that a filter dropped) don't end a run
                        run, local, piece = (f, r), 0, piece + 1
                        firsts.append(f)
                    last = (f, r)
                    run_of[:, k] = len(firsts) - 1, run[1], piece, local
                    local += n
                file, row, own_piece, begin = np.repeat(run_of, per, axis=1)
                out = {"task": pa.array(np.full(len(owner), task, np.int32)), "piece": pa.array(own_piece.astype(np.int32)), "local": pa.array(begin + part)}
                if tokens:
                    offsets = np.append(starts, ends[-1:]).astype(np.int32) * 2
                    out["tokens"] = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])
                else:
                    out |= {"run_file": pa.array(firsts, pa.string()).take(pa.array(file)), "run_row": pa.array(row)}
                    out |= {"doc_id": b.column(0).slice(i, j - i).take(pa.array(owner)), "part": pa.array(part, pa.int32()), "n_tokens": pa.array(ends - starts, pa.int32())}
                yield pa.RecordBatch.from_pydict(out)

    return common.map_batches(rows, work, "task int, piece int, local bigint, " + ("tokens binary" if tokens else f"run_file string, run_row bigint, doc_id {kind}, part int, n_tokens int"))


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Scans in here are split alike, even if executors come or go between them."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def _offsets(runs: DataFrame) -> DataFrame:
    """runs with ``offset``, the sum of n over the runs before: within each range of runs, and then over the
    ranges, of which there are no more than shuffle partitions."""
    order = ["run_file", "run_row", "task", "piece"]
    ranged = common.stage(runs.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("range").agg(F.sum("n").alias("total")).select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return inner.join(F.broadcast(bases), "range").select("task", "piece", (F.col("base") + F.col("inner")).alias("offset"), "n")


def materialise(docs: DataFrame, path: str | None = None, model: str = MODEL, length: int = LENGTH, per_shard: int | None = None, key: str = KEY) -> DataFrame:
    """Write the shards under ``path`` (a new shared folder if None) and return one row for each
    sequence: slot, doc_id, part, n_tokens, shard, byte_offset in it. Shard k is the k-th file of
    the folder (column ``folder``) by name; slot s begins at byte (s % per_shard) * stride of shard s // per_shard, so
    that reading can resume anywhere.

    The texts are read twice: a first pass only counts, so that no token is kept on disk between
    the passes; a second pass that doesn't meet the runs and numbers of the first fails."""
    spark = docs.sparkSession
    rows, path = _rows(docs), path or common.shared_dir(spark)
    with _same_splits(spark):
        numbered = common.stage(sequences(rows, False, model, length))
        runs = numbered.groupBy("task", "piece", "run_file", "run_row").agg(F.count("*").alias("n"))
        runs = common.stage(_offsets(runs))
        count, total = runs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        per_shard = per_shard or max(PER_SHARD, -(-total // MOST_SHARDS))
        placed = F.pandas_udf(lambda i: pd.Series(slots(i.to_numpy(), total, key)), "bigint")
        offsets = F.broadcast(runs) if count <= MOST_RUNS else runs

        def dealt(d: DataFrame) -> DataFrame:
            changed = F.raise_error(F.lit("a run of rows that the first pass didn't see: the input or its splits changed")).cast("bigint")
            offset = F.when(F.col("local") < F.col("n"), F.col("offset")).otherwise(changed)
            d = d.join(offsets, ["task", "piece"], "left").withColumn("slot", placed(offset + F.col("local")))
            return d.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))

        mark = END.to_bytes(2, "little")
        if shards := -(-total // per_shard):
            record = F.rpad(F.col("tokens"), 2 * length, F.lit(mark)).cast("string").alias("record")
            d = dealt(sequences(rows, True, model, length)).select("slot", "shard", "tokens")
            d = d.repartitionById(shards, "shard").sortWithinPartitions("slot").select(record)
            written = Observation()
            d.observe(written, F.count("*").alias("n")).write.option("lineSep", mark.decode("latin-1")).text(path)
            if written.get["n"] != total:
                raise ValueError(f"the second pass wrote {written.get['n']} of {total} sequences: the input or its splits changed")
    return dealt(numbered).select("slot", "doc_id", "part", "n_tokens", "shard", ((F.col("slot") % per_shard) * 2 * (length + 1)).alias("byte_offset"), F.lit(path).alias("folder"))
