"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify every pair.

Documents with equal n-gram sets are one node, so copies cost nothing beyond their count. Nodes that
share a band hash are candidates; ``bands_for`` picks rows and bands for a target recall. No pair of
nodes ever becomes a row: a node lives in one block of about BLOCK nodes, chosen by popular bands;
two blocks meet if some band has nodes of both, and one task compares their full sets with a
matrix product, unless the sizes of their sets are too far apart for any link. A task returns for each of its nodes the number of linked documents and one edge of a
spanning forest. Classes are the connected components of those edges.

Cases: a text of 1 to N - 1 words has one n-gram, all its words; null texts and texts without a word
have no n-gram, no link, and are a class of their own; rows with a null doc_id have their links, and the least doc_id
of their class, which is null where all its ids are; repeated rows are copies of each other; very long texts are hashed whole, in
blocks of whole texts; at the similarity itself there is a link, and of equal labels the least doc_id names
the class; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

N, SIMILARITY, RECALL = 5, 0.8, 0.999
MOST_HASHES = 128
BLOCK = 256
CHUNK = 4096


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows as ``most`` hashes allow, and the fewest bands that reach the
    recall at the similarity; more rows mean fewer false candidates."""
    found = [(ceil(log(1 - recall) / log(1 - similarity**r)), r) for r in range(1, 17)]
    return max(((b, r) for b, r in found if b * r <= most), key=lambda x: x[1], default=found[0])


def _families(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = common.mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return (seeds[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[count:] >> np.uint64(32)).astype(np.uint32)


def distinct(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, ascending, and where each text's begin."""
    found, at = common.shingles(texts, n)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(texts)))]) if len(texts) else np.zeros(1, np.int64)


def _names(found: np.ndarray, at: np.ndarray, full: np.ndarray) -> np.ndarray:
    """16 bytes that name each non-empty set."""
    two = [np.add.reduceat(common.mix(found ^ np.uint64(k)), at[:-1][full]) for k in (0, 0x5BD1E995)]
    return np.stack(two, axis=1)


def signatures(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n: int = N) -> DataFrame:
    """doc_id, node (the name of its n-gram set; null without n-grams), size of the set and band hashes of each row."""
    bands, rows = bands_for(similarity, recall)
    a, b = _families(bands * rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in common.blocks(batch.column(1)):
                found, at = distinct(batch.column(1).slice(i, j - i), n)
                full = np.flatnonzero(np.diff(at))
                node, own = [None] * (j - i), [None] * (j - i)
                sizes = np.diff(at)
                if len(full):
                    small, starts = (found >> np.uint64(32)).astype(np.uint32), at[:-1][full]
                    hashes = np.zeros((bands, len(full)), np.uint64)
                    for k in range(bands * rows):
                        low = np.minimum.reduceat(small * a[k] + b[k], starts)
                        hashes[k // rows] = common.mix(hashes[k // rows] * np.uint64(0x100000001B3) + low + np.uint64(k // rows + 1))
                    for r, name, h in zip(full.tolist(), _names(found, at, full), hashes.T.view(np.int64), strict=True):
                        node[r], own[r] = name.tobytes(), h
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(node, pa.binary()), pa.array(sizes, pa.int32()), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "node", "grams", "bands"])

    return common.map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, node binary, grams int, bands array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, block, copies and n-gram set of the wanted rows (doc_id, node, block, copies)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in common.blocks(batch.column(3)):
                found, at = distinct(batch.column(3).slice(i, j - i), n)
                full = np.flatnonzero(np.diff(at))
                if not len(full):
                    continue
                # Another row may have this id and another text.
                same = np.array([x.tobytes() for x in _names(found, at, full)], object) == np.array(batch.column(0).slice(i, j - i).to_pylist(), object)[full]
                keep = full[same]
                rows = pa.array(keep + i)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(3)), pa.array([found[at[k] : at[k + 1]].tobytes() for k in keep.tolist()], pa.binary())], ["node", "block", "copies", "set"])

    d = docs.select("doc_id", "text").join(wanted, "doc_id").select("node", "block", "copies", "text")
    return common.map_batches(d, work, "node binary, block bigint, copies bigint, set binary")


def links(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Which sets of the left reach the similarity with which of the right (None: of the left)."""
    both = left + (right or [])
    sizes = np.array([len(x) for x in both])
    values, number, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    keep = counts[number] > 1
    row, col = np.repeat(np.arange(len(both)), sizes)[keep], shared[number[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    m = len(left)
    common_count = np.zeros((m, len(both) - m if right is not None else m))
    for k in range(0, int(col[-1]) + 1 if len(col) else 0, CHUNK):
        i, j = np.searchsorted(col, [k, k + CHUNK])
        x = np.zeros((len(both), CHUNK), np.float32)
        x[row[i:j], col[i:j] - k] = 1
        common_count += x[:m] @ (x[m:] if right is not None else x).T
    union = sizes[:m, None] + (sizes[m:] if right is not None else sizes)[None, :] - common_count
    return common_count >= similarity * union - 1e-9


def _roots(edges: Iterator[tuple[int, int]], count: int) -> list[int]:
    up = list(range(count))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in edges:
        i, j = root(i), root(j)
        if i != j:
            up[max(i, j)] = min(i, j)
    return [root(i) for i in range(count)]


def compare(pair: pd.DataFrame, similarity: float = SIMILARITY) -> pd.DataFrame:
    """For the nodes of two blocks (one, if equal): linked documents and an edge to the first node
    of their tree. Nodes without a link are left out."""
    d = pair.drop_duplicates("node").sort_values("node", ignore_index=True)
    sets = [np.frombuffer(x, np.uint64) for x in d["set"]]
    copies = d["copies"].to_numpy()
    one = (d["block"] == pair["one"].iloc[0]).to_numpy()
    linked = np.zeros((len(d), len(d)), bool)
    if pair["one"].iloc[0] == pair["two"].iloc[0]:
        linked = links(sets, None, similarity)
        np.fill_diagonal(linked, False)
    elif one.any() and not one.all():
        i, j = np.flatnonzero(one), np.flatnonzero(~one)
        linked[np.ix_(i, j)] = links([sets[k] for k in i], [sets[k] for k in j], similarity)
        linked |= linked.T
    roots = np.array(_roots(zip(*(x.tolist() for x in np.nonzero(np.triu(linked))), strict=True), len(d)), int)
    some = np.flatnonzero(linked.any(axis=1))
    return pd.DataFrame({"node": d["node"].to_numpy()[some], "root": d["node"].to_numpy()[roots[some]], "links": (linked @ copies)[some].astype(np.int64)})


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) from edges (node, root), each node at least
    once. Every round takes the least label of the neighbours and then the label of that label; a
    round is a table in the shared folder."""
    both = common.stage(edges.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(edges.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))).distinct())
    labels = common.stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = common.stage(nearer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def _blocks(shared: DataFrame, similarity: float) -> DataFrame:
    """node, block and grams of every candidate (shared: node, grams, band, n). A node's home is its most popular
    band. Homes follow the most popular home met in their band, twice; those that come together are packed into
    blocks of about BLOCK nodes. A larger home is split by the size of the sets, in steps of which two span the
    similarity, and then by hash."""
    home = common.stage(shared.groupBy("node").agg(F.max(F.struct("n", "band")).alias("h"), F.first("grams").alias("grams")).select("node", "grams", "h.n", "h.band"))
    met = shared.select("node", F.col("band").alias("via")).join(home, "node").groupBy("via").agg(F.max(F.struct("n", "band")).alias("t"))
    homes = common.stage(home.groupBy("band").agg(F.count("*").alias("size")).join(met.select(F.col("via").alias("band"), F.col("t.band").alias("next")), "band"))
    for _ in range(2):
        jump = homes.select(F.col("band").alias("next"), F.col("next").alias("jumped"))
        homes = homes.join(jump, "next", "left").select("band", "size", F.coalesce("jumped", "next").alias("next"))
    before = Window.partitionBy("next", F.col("size") > BLOCK).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    packed = F.when(F.col("size") > BLOCK, -1).otherwise(F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / BLOCK))
    homes = homes.withColumn("chunk", packed.cast("long"))
    step = F.floor(F.log("grams") / (-log(similarity) / 2)).cast("int")
    home = home.withColumn("step", step)
    steps = home.groupBy("band", "step").agg(F.count("*").alias("in_step"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("in_step") / BLOCK))
    block = F.when(F.col("chunk") < 0, F.xxhash64("band", F.lit(1), "step", part)).otherwise(F.xxhash64("next", F.lit(0), "chunk"))
    return home.drop("n").join(homes, "band").join(steps, ["band", "step"]).select("node", block.alias("block"), "grams")


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n: int = N) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and n_links (other documents that reach the
    similarity) of every row."""
    docs = docs.select("doc_id", "text")
    if docs.where("doc_id IS NULL").isEmpty():
        return _join(docs, similarity, recall, n)
    out = _join(common.keyed(docs), similarity, recall, n)
    return out.select("doc_id.id", "class_id.id", "n_links").toDF("doc_id", "class_id", "n_links")


def _join(docs: DataFrame, similarity: float, recall: float, n: int) -> DataFrame:
    """The same for ids of any type that are never null."""
    signed = common.stage(signatures(docs, similarity, recall, n))
    nodes = common.stage(signed.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("grams").alias("grams"), F.first("bands").alias("bands")))
    bands = nodes.select("node", "grams", F.explode("bands").alias("band"))
    popular = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = common.stage(bands.join(popular, "band"))
    blocks = common.stage(_blocks(shared, similarity))
    # Which blocks meet: by band over blocks, not over nodes; those whose sets differ too much in size don't.
    there = shared.select("node", "band").join(blocks, "node").groupBy("band", "block").agg(F.min("grams").alias("least"), F.max("grams").alias("most"))
    side = lambda name: there.select("band", F.col("block").alias(name), F.col("least").alias(f"least_{name}"), F.col("most").alias(f"most_{name}"))
    near = (F.col("most_one") >= similarity * F.col("least_two") - 1e-6) & (F.col("most_two") >= similarity * F.col("least_one") - 1e-6)
    meet = side("one").join(side("two"), "band").where(F.col("one") <= F.col("two")).where(near).select("one", "two").distinct()
    uses = common.stage(meet.select("one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block")))
    wanted = common.stage(nodes.drop("bands", "grams").join(blocks.drop("grams"), "node").select(F.col("first_id").alias("doc_id"), "node", "block", "copies"))
    sets = _sets(docs, common.small(wanted), n).join(common.small(uses), "block")
    found = common.stage(sets.groupBy("one", "two").applyInPandas(lambda pair: compare(pair, similarity), "node binary, root binary, links bigint"))
    labels = components(found.select("node", "root"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = nodes.select("node", "copies", "first_id").join(counts, "node", "left").join(labels, "node", "left")
    info = common.stage(info.where("copies > 1 OR links > 0").select("node", F.coalesce("label", "node").alias("label"), "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    firsts = info.groupBy("label").agg(F.min("first_id").alias("class_id"))
    info = info.join(firsts, "label").select("node", "class_id", "n_links")
    return signed.select("doc_id", "node").join(info, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that aren't the first of their class, whatever their ids."""
    docs = common.keyed(docs)
    classes = common.stage(_join(docs.select("doc_id", "text"), SIMILARITY, RECALL, N))
    kept = common.without(docs, classes.where("doc_id <> class_id").select("doc_id"))
    if not classes.where("doc_id = class_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        # Rows that share an id and a text: a single one stays.
        kept = kept.dropDuplicates(["doc_id"])
    return common.unkeyed(kept)
