"""Similarity and clustering of entities by numeric features (entity, v).

The nearest pairs and the largest distance come from bounds by distances to pivots (the triangle inequality), so they don't form all pairs. What
is defined over all pairs (silhouettes, mean similarities) meets block by block: a block of entities stays in its
task and the others pass by, in numpy. Only ``similarity`` without ``top``, whose result are all pairs, has a limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from aerolake import rounds
from aerolake.operators import places

#: Entities whose pairs are a result at most.
MOST = 5000
#: Entities of a block, pivots of the nearest pairs, neighbours in the order of each pivot that give the first bound.
BLOCK, PIVOTS, AROUND = 512, 3, 8
# From this many deviations on a feature tells a cluster apart, and the words for it.
APART, HIGH, LOW, EVEN, KIND, AND = 0.55, "偏高", "偏低", "特征均衡型", "型", "、"


def _few(features: DataFrame) -> DataFrame:
    if features.limit(MOST + 1).count() > MOST:
        raise ValueError(f"all pairs of more than {MOST} entities")
    return features


def _distance(a: Column | str, b: Column | str, kind: str = "euclidean") -> Column:
    parts = F.zip_with(a, b, lambda x, y: F.abs(x - y) if kind == "manhattan" else (x - y) * (x - y))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return total if kind == "manhattan" else F.sqrt(total)


def _blocks(d: DataFrame, columns: list[str], size: int) -> DataFrame:
    """block, blocks (how many) and rows: ``size`` rows of d at most, by entity."""
    d = places.numbered(d, [], ["entity"], "_p", "_n")
    d = d.withColumn("block", F.floor((F.col("_p") - 1) / size).cast("int")).withColumn("blocks", F.ceil(F.col("_n") / size).cast("int"))
    return rounds.cut(d.groupBy("block", "blocks").agg(F.collect_list(F.struct(*columns)).alias("rows")))


def _meetings(blocks: DataFrame, twice: bool) -> DataFrame:
    """Each block at home (dest = block), followed in its task by the blocks that visit it: all others if ``twice``, else of every two
    blocks one the other."""
    away = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("blocks") - 1)), lambda k: F.pmod(F.col("block") + k, F.col("blocks")))
    # Of two blocks the one with half of the ring ahead or less goes; opposite ones by number.
    ahead = lambda x: F.pmod(x - F.col("block"), F.col("blocks")) * 2
    if not twice:
        away = F.filter(away, lambda x: (ahead(x) < F.col("blocks")) | ((ahead(x) == F.col("blocks")) & (x > F.col("block"))))
    visits = blocks.where("blocks > 1").withColumn("dest", F.explode(away))
    d = blocks.withColumn("dest", F.col("block")).unionByName(visits)
    return d.repartition("dest").sortWithinPartitions("dest", F.col("block") != F.col("dest"))


def _far(features: DataFrame, kind: str, size: int) -> float:
    """The largest distance of two entities. Whoever is a part of it lies so far from every pivot that the farthest from
    there could make up the best distance known; the others take no part."""
    d, known, pivots = features, 0.0, []
    at = features.orderBy("entity").select("v").first()["v"]
    for i in range(6 if features.limit(size + 1).count() > size else 0):  # one block needs no bounds
        here = F.lit([float(x) for x in at])
        d = d.withColumn(f"f{i}", _distance("v", here, kind))
        far = d.agg(F.max_by(F.struct("v"), F.struct(f"f{i}", "entity")).alias("v"), F.max(f"f{i}").alias("d"), *((F.avg(F.get("v", j)).alias(f"m{j}") for j in range(len(at))) if i == 3 else ())).first()
        if i < 4:
            known = max(known, far["d"])
        pivots.append(far["d"])
        # The middle serves well as a bound, though it is no entity.
        at = [far[f"m{j}"] for j in range(len(at))] if i == 3 else far["v"]["v"]
    for i, most in enumerate(pivots):
        d = d.where(F.col(f"f{i}") + most >= known * (1 - 1e-12))

    def farthest(rows: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        best, home = 0.0, None
        for b in rows:
            for block, dest, some in zip(*(b.column(c) for c in ("block", "dest", "rows")), strict=True):
                x = np.array([r["v"] for r in some.as_py()], float)
                home = x if block.as_py() == dest.as_py() else home
                for r in x:
                    part = np.abs(home - r)
                    best = max(best, float((part.sum(axis=1) if kind == "manhattan" else np.sqrt((part * part).sum(axis=1))).max(initial=0.0)))
        yield pa.RecordBatch.from_pydict({"best": [best]})

    met = _meetings(_blocks(d.select("entity", "v"), ["v"], size), False).select("block", "dest", "rows")
    return max(known, met.mapInArrow(farthest, "best double").agg(F.max("best")).first()[0] or 0.0)


def nearest_pairs(features: DataFrame, kind: str = "euclidean", top: int = 12, few: int = BLOCK) -> DataFrame:
    """left, right and distance of the pairs among which are the ``top`` nearest: all pairs up to the distance of the last of them.

    Up to ``few`` entities these are all pairs. Else entities side by side in the order of their distance to a pivot give a first bound. Then entities fall into cells
    as wide as the bound by their distances to the pivots: nearer pairs lie in neighbouring cells, and only these are formed.
    With a bound of 0 (copies) the first of each group of copies make up the nearest pairs."""
    d, bound = rounds.cut(features.select("entity", F.col("v").cast("array<double>").alias("v"))), float("inf")
    if d.limit(few + 1).count() > max(few, AROUND):
        at = d.orderBy("entity").select("v").first()["v"]
        for i in range(PIVOTS):
            d = d.withColumn(f"d{i}", _distance("v", F.lit([float(x) for x in at]), kind))
            apart = F.least(*(F.col(f"d{k}") for k in range(i + 1))) if i else F.col("d0")
            at = d.agg(F.max_by(F.struct("v"), F.struct(apart, F.col("entity")))).first()[0]["v"]
        d = rounds.cut(d)
        near = None
        for i in range(PIVOTS):
            w = Window.partitionBy("_part").orderBy(f"d{i}", "entity")
            ranged = d.repartitionByRange(f"d{i}", "entity").withColumn("_part", F.spark_partition_id())
            others = F.array(*(F.struct(F.lead("entity", k).over(w).alias("e"), F.lead("v", k).over(w).alias("o")) for k in range(1, AROUND + 1)))
            beside = ranged.withColumn("xs", others).select("entity", "v", F.explode("xs").alias("x")).where("x.e IS NOT NULL")
            beside = beside.select(F.least("entity", "x.e").alias("left"), F.greatest("entity", "x.e").alias("right"), _distance("v", "x.o", kind).alias("distance"))
            near = beside if near is None else near.unionByName(beside)
        first = near.distinct().agg(InternalFunction.collect_top_k(F.struct("distance", "left", "right"), top, True).alias("k")).first()["k"]
        bound = first[-1]["distance"] if len(first) == top else bound
    if bound == 0.0:
        copies = d.groupBy("v").agg(InternalFunction.collect_top_k(F.col("entity"), top + 1, True).alias("e")).where(F.size("e") > 1)
        pair = F.flatten(F.transform("e", lambda a, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda b: F.struct(a.alias("left"), b.alias("right")))))
        return copies.select(F.inline(pair)).withColumn("distance", F.lit(0.0))
    if bound == float("inf"):
        cells, shifts = d.withColumn("cell", F.array(F.lit(0))), [[0]]
    else:
        wide = bound * (1 + 1e-9)
        cells = d.withColumn("cell", F.array(*(F.floor(F.col(f"d{i}") / wide) for i in range(PIVOTS))))
        shifts = [[x, y, z] for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    key = lambda c, shift: F.array(*(F.get(c, i) + s for i, s in enumerate(shift)))
    a = cells.select(F.col("entity").alias("left"), F.col("v").alias("lv"), F.explode(F.array(*(key(F.col("cell"), s) for s in shifts))).alias("cell"))
    b = cells.select(F.col("entity").alias("right"), F.col("v").alias("rv"), "cell")
    out = a.join(b, (a["cell"] == b["cell"]) & (F.col("left") < F.col("right"))).select("left", "right", _distance("lv", "rv", kind).alias("distance"))
    return out.where(F.col("distance") <= bound * (1 + 1e-9)) if bound < float("inf") else out


def similarity(features: DataFrame, kind: str = "euclidean", top: int | None = 12, block: int = BLOCK) -> DataFrame:
    """Distance and similarity (1 - d / max d) of the ``top`` most similar pairs of entities, or of all pairs (of MOST entities at most)."""
    if top:
        d = nearest_pairs(features, kind, top, block)
        most = F.lit(_far(features, kind, block) if not features.isEmpty() else 0.0)
    else:
        a, b = _few(features).select(F.col("entity").alias("left"), F.col("v").alias("lv")), features.select(F.col("entity").alias("right"), F.col("v").alias("rv"))
        d = a.join(b, F.col("left") < F.col("right")).select("left", "right", _distance("lv", "rv", kind).alias("distance"))
        d = d.join(F.broadcast(d.agg(F.max("distance").alias("most"))))  # one row
        most = F.col("most")
    d = d.select("left", "right", "distance", F.when(most > 0, 1 - F.col("distance") / most).otherwise(1.0).alias("similarity"))
    return d.orderBy(F.desc("similarity"), "left", "right").limit(top) if top else d


def _keyed(entity: Column, *key: int | str) -> Column:
    """A number between 0 and 1, the same for an entity and key wherever the row lies."""
    return (F.pmod(F.xxhash64(F.lit("|".join(map(str, key))), entity), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _drawn(features: DataFrame, k: int, restarts: int, seed: int) -> list[list[list[float]]]:
    """k-means++ centres for each restart. An entity is drawn in proportion to its squared distance to the centres so far:
    of -ln(u) / d² by a keyed u for each entity, the least wins. All restarts draw in one pass; if all
    entities are centres already, the draw is even."""
    d = features.withColumn("d2", F.array(*(F.lit(float("inf")) for _ in range(restarts))))
    centres: list[list[list[float]]] = [[] for _ in range(restarts)]
    for step in range(k):
        if step:
            last = F.lit([c[-1] for c in centres])
            d = d.withColumn("d2", F.zip_with("d2", last, lambda old, c: F.least(old, F.pow(_distance(F.col("v"), c), 2))))
        race = [F.struct((-F.ln(_keyed(F.col("entity"), seed, r, step)) / (F.get("d2", r) if step else F.lit(1.0))).alias("x"), F.col("entity")) for r in range(restarts)]
        even = [F.struct(_keyed(F.col("entity"), seed, r, step).alias("x"), F.col("entity")) for r in range(restarts)]
        ok = [F.get("d2", r) > 0 for r in range(restarts)]
        got = d.agg(*(F.min_by("v", F.when(ok[r], race[r])).alias(f"a{r}") for r in range(restarts)), *(F.min_by("v", even[r]).alias(f"b{r}") for r in range(restarts))).first()
        for r in range(restarts):
            centres[r].append([float(x) for x in (got[f"a{r}"] or got[f"b{r}"])])
    return centres


def _assigned(centres: list, before: list | None) -> Callable[[Iterator], Iterator]:
    """A task's sums for each restart and centre: rows, sum of v, inertia, rows whose centre has changed, and the k rows
    farthest from their centres."""
    k = len(centres[0])

    def work(batches: Iterator) -> Iterator:
        import heapq

        import numpy as np
        import pyarrow as pa

        at, old = np.array(centres, float), None if before is None else np.array(before, float)
        restarts, _, dims = at.shape
        n, sums, inertia, moved = np.zeros((restarts, k), int), np.zeros((restarts, k, dims)), np.zeros((restarts, k)), np.zeros(restarts, int)
        far: list[list] = [[] for _ in range(restarts)]
        for b in batches:
            v = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, dims)
            names = b.column(0).to_pylist()
            for r in range(restarts):
                d = ((v[:, None, :] - at[r]) ** 2).sum(axis=2)
                label, least = d.argmin(axis=1), d.min(axis=1)
                n[r] += np.bincount(label, minlength=k)
                inertia[r] += np.bincount(label, least, k)
                for j in range(dims):
                    sums[r, :, j] += np.bincount(label, v[:, j], k)
                moved[r] += len(v) if old is None else int((((v[:, None, :] - old[r]) ** 2).sum(axis=2).argmin(axis=1) != label).sum())
                rows = np.argsort(-least, kind="stable")[: 4 * k]
                rows = np.flatnonzero(least >= least[rows[-1]]) if len(rows) else rows  # equals go by name
                far[r] = heapq.nsmallest(k, far[r] + [(-least[i], names[i], v[i].tolist()) for i in rows])
        yield pa.RecordBatch.from_pylist([
            {"restart": r, "label": c, "n": int(n[r, c]), "inertia": float(inertia[r, c]), "moved": int(moved[r]) if c == 0 else 0, "sums": sums[r, c].tolist(), "far": [{"d": float(d), "entity": e, "v": x} for d, e, x in far[r]] if c == 0 else []}
            for r in range(restarts) for c in range(k)
        ], schema=pa.schema([("restart", pa.int32()), ("label", pa.int32()), ("n", pa.int64()), ("inertia", pa.float64()), ("moved", pa.int64()), ("sums", pa.list_(pa.float64())), ("far", pa.list_(pa.struct([("d", pa.float64()), ("entity", pa.string()), ("v", pa.list_(pa.float64()))])))]))

    return work


def fit(features: DataFrame, k: int, restarts: int = 10, seed: int = 1, iterations: int = 300) -> tuple[list[list[float]], float]:
    """Centres and inertia of the best of several runs of k-means, the first of equals. Each iteration is one pass for all
    restarts, of which the driver gets restarts * k rows. A centre without rows moves to the row farthest from its centre (the next
    one to the second, and so on); a run ends when no row changes its centre."""
    centres, before, done = _drawn(features, k, restarts, seed), None, {}
    dims = len(centres[0][0])
    schema = "restart int, label int, n bigint, inertia double, moved bigint, sums array<double>, far array<struct<d:double,entity:string,v:array<double>>>"
    active = list(range(restarts))
    for _ in range(iterations):
        d = features.select("entity", "v").mapInArrow(_assigned([centres[r] for r in active], None if before is None else [before[r] for r in active]), schema)
        far = d.select("restart", F.explode("far").alias("f")).groupBy("restart").agg(InternalFunction.collect_top_k(F.col("f"), k, True).alias("far"))
        got = d.groupBy("restart", "label").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.sum("moved").alias("moved"), *(F.sum(F.get("sums", j)).alias(f"s{j}") for j in range(dims)))
        rows = {(active[r["restart"]], r["label"]): r for r in got.collect()}
        empty = [r for r in active if any(not rows[r, c]["n"] for c in range(k))]
        farthest = {active[r["restart"]]: r["far"] for r in far.collect()} if empty else {}
        before, still = list(centres), []
        for r in active:
            if not any(rows[r, c]["moved"] for c in range(k)):
                done[r] = sum(rows[r, c]["inertia"] for c in range(k))
                continue
            still.append(r)
            spare = iter(farthest.get(r, ()))
            centres[r] = [[rows[r, c][f"s{j}"] / rows[r, c]["n"] for j in range(dims)] if rows[r, c]["n"] else list(next(spare)["v"]) for c in range(k)]
            done[r] = sum(rows[r, c]["inertia"] for c in range(k))
        active = still
        if not active:
            break
    best = min(done, key=lambda r: (round(done[r], 9), r))
    return centres[best], done[best]


def cluster(features: DataFrame, k: int, restarts: int = 10, seed: int = 1) -> DataFrame:
    """entity and cluster of the best of several runs of k-means (``fit``); clusters are numbered by their least entity, so
    that equal partitions have equal numbers. Nothing for under two clusters or fewer entities than clusters."""
    d = rounds.cut(features.select("entity", F.col("v").cast("array<double>").alias("v")))
    if k < 2 or d.limit(k).count() < k:
        return d.where("false").select("entity", F.lit(0).alias("cluster"))
    centres, _ = fit(d, k, restarts, seed)
    near = F.array_min(F.transform(F.lit(centres), lambda c, i: F.struct(F.pow(_distance(F.col("v"), c), 2).alias("d"), i.alias("c"))))["c"]
    found = d.select("entity", near.alias("c"))
    firsts = found.groupBy("c").agg(F.min("entity").alias("first"))  # a row for each cluster
    numbers = firsts.withColumn("cluster", (F.row_number().over(Window.orderBy("first")) - 1).cast("int")).drop("first")
    return found.join(F.broadcast(numbers), "c").select("entity", "cluster")


def choose_k(features: DataFrame, least: int = 2, most: int = 6, restarts: int = 10) -> DataFrame:
    """k, silhouette and best for each number of clusters up to one less than the entities; the best has the
    largest silhouette, else the first one is."""
    spark, n = features.sparkSession, features.count()
    rows = []
    for k in range(least, min(most, max(least, n - 1)) + 1):
        s = silhouette(features, cluster(features, k, restarts)).first()["silhouette"]
        rows.append((k, s))
    scored = [r for r in rows if r[1] is not None]
    best = max(scored, key=lambda r: (r[1], -r[0]))[0] if scored else rows[0][0]
    return spark.createDataFrame([(k, s, k == best) for k, s in rows], "k int, silhouette double, best boolean")


def mean_distances(features: DataFrame, clusters: DataFrame, size: int = BLOCK) -> DataFrame:
    """entity, cluster, other and m: the mean Euclidean distance of every entity to those of each cluster, itself left out. All
    entities meet all others in blocks; a task holds one block and its sums by cluster."""
    d = features.join(clusters, "entity").select("entity", F.col("cluster").cast("int").alias("cluster"), F.col("v").cast("array<double>").alias("v"))

    def meet(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        home: dict = {}

        def given() -> Iterator:
            if home:
                rows = [(e, int(c), int(o), float(s[i] / (count - (o == c)))) for o, (s, count) in home["sums"].items() for i, (e, c) in enumerate(zip(home["names"], home["clusters"], strict=True)) if count > (o == c)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[j] for r in rows], pa.int32()) for j in (1, 2)), pa.array([r[3] for r in rows], pa.float64())], names=["entity", "cluster", "other", "m"])

        for b in batches:
            for block, dest, some in zip(*(b.column(c) for c in ("block", "dest", "rows")), strict=True):
                some = some.as_py()
                x, of = np.array([r["v"] for r in some], float), np.array([r["cluster"] for r in some])
                if block.as_py() == dest.as_py():
                    yield from given()
                    home = {"v": x, "names": [r["entity"] for r in some], "clusters": of, "sums": {}}
                for c in np.unique(of):
                    total, count = home["sums"].get(int(c), (np.zeros(len(home["v"])), 0))
                    for y in x[of == c]:
                        total = total + np.sqrt(((home["v"] - y) ** 2).sum(axis=1))
                    home["sums"][int(c)] = total, count + int((of == c).sum())
        yield from given()

    return _meetings(_blocks(d, ["entity", "cluster", "v"], size), True).select("block", "dest", "rows").mapInArrow(meet, "entity string, cluster int, other int, m double")


def cluster_report(features: DataFrame, clusters: DataFrame, names: list[str], top: int = 4) -> DataFrame:
    """Each cluster of standardised features (entity, v): size, centroid, what tells it apart (``top`` features of
    |z| from APART on), a label in words, and its members with their mean similarity to the others."""
    d = features.join(clusters, "entity")
    most = _far(features, "euclidean", BLOCK) if not features.isEmpty() else 0.0
    near = mean_distances(features, clusters).where("cluster = other").select("entity", (F.lit(1.0) - F.col("m") / most if most > 0 else F.lit(1.0)).alias("affinity"))
    member = F.struct((-F.round(F.coalesce("affinity", F.lit(1.0)), 4)).alias("order"), "entity")
    centre = [F.avg(F.get("v", i)).alias(f"m{i}") for i in range(len(names))]
    out = d.join(near, "entity", "left").groupBy("cluster").agg(F.count("*").alias("size"), *centre, F.array_sort(F.collect_list(member)).alias("m"))  # the members are the result
    z = F.array(*(F.struct(F.lit(n).alias("feature"), F.round(f"m{i}", 3).alias("z")) for i, n in enumerate(names)))
    apart = F.array_sort(F.filter(z, lambda x: F.abs(x["z"]) >= APART), lambda a, b: F.when(F.abs(a["z"]) > F.abs(b["z"]), -1).when(F.abs(a["z"]) < F.abs(b["z"]), 1).otherwise(0))
    word = lambda x: F.concat(x["feature"], F.when(x["z"] > 0, HIGH).otherwise(LOW))
    out = out.withColumn("apart", F.slice(apart, 1, top))
    label = F.when(F.size("apart") == 0, EVEN).otherwise(F.concat(F.array_join(F.transform(F.slice("apart", 1, 2), word), AND), F.lit(KIND)))
    members = F.transform("m", lambda x: F.struct(x["entity"].alias("entity"), (-x["order"]).alias("affinity")))
    return out.select("cluster", "size", label.alias("label"), members.alias("members"), F.array(*(F.col(f"m{i}") for i in range(len(names)))).alias("centroid"), "apart").orderBy(F.desc("size"), "cluster")


def silhouette(features: DataFrame, clusters: DataFrame, size: int = BLOCK) -> DataFrame:
    """Mean silhouette (Euclidean); members of a cluster of one are skipped."""
    means = mean_distances(features, clusters, size)
    s = means.groupBy("entity").agg(F.max(F.when(F.col("cluster") == F.col("other"), F.col("m"))).alias("own"), F.min(F.when(F.col("cluster") != F.col("other"), F.col("m"))).alias("near"))
    return s.where("own IS NOT NULL AND near IS NOT NULL").agg(F.avg(F.try_divide(F.col("near") - F.col("own"), F.greatest("own", "near"))).alias("silhouette"), F.count("*").alias("n"))
