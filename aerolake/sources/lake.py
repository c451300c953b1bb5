"""The Parquet lake: declared schemas, scans with partition pruning, coercion, idempotent upsert."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.operators.joins import keep_last

#: Columns that every writer may add.
INJECTED = {"city_id", "ingested_at", "source_run_id"}
TYPES = {"string": T.StringType(), "double": T.DoubleType(), "integer": T.LongType(), "timestamp": T.TimestampNTZType(), "date": T.DateType(), "boolean": T.BooleanType()}


@dataclass(frozen=True)
class Asset:
    """A governed table: columns by declared type, its key, its time column (None: not split by month), and
    what the catalog and the checks know of it; ``info`` of a column may hold unit, description, range, enum
    and nullable."""

    key: str
    columns: dict[str, str]
    primary_key: tuple[str, ...]
    time: str | None = "time"
    name: str = ""
    domain: str = ""
    layer: str = ""
    owner: str = ""
    status: str = "active"
    description: str = ""
    granularity: str = "hourly"
    sla_minutes: int | None = None
    tags: tuple[str, ...] = ()
    info: dict[str, dict] = field(default_factory=dict)

    @property
    def schema_hash(self) -> str:
        """SHA-256 of the columns' canonical JSON."""
        columns = [{"name": c, "type": t, **self.info.get(c, {})} for c, t in self.columns.items()]
        return hashlib.sha256(json.dumps(columns, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, TYPES[t]) for c, t in self.columns.items()])

    @property
    def parts(self) -> list[str]:
        return ["city", "year", "month"] if self.time else ["city"]


def coerced(c: Column, kind: str) -> Column:
    """A value as its declared type; what can't be converted is null, whole numbers round half even."""
    if kind == "integer":
        return F.bround(c.try_cast("double")).cast("long")
    if kind == "double":
        x = c.try_cast("double")
        return F.when(~F.isnan(x), x)
    if kind == "boolean":  # any non-empty text is true
        return F.when(c.cast("string").isNotNull(), ~F.lower(c.cast("string")).isin("", "0", "0.0", "false"))
    return c.try_cast({"timestamp": "timestamp_ntz"}.get(kind, kind))


def aligned(df: DataFrame, asset: Asset) -> tuple[DataFrame, list[str], list[str]]:
    """df with the declared columns in order, the missing ones (null) and the extra ones (dropped)."""
    missing, extra = [c for c in asset.columns if c not in df.columns], [c for c in df.columns if c not in asset.columns]
    return df.select(*((coerced(F.col(c), t) if c in df.columns else F.lit(None).cast(TYPES[t])).alias(c) for c, t in asset.columns.items())), missing, extra


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def has_data(spark: SparkSession, root: str, asset: Asset, city: str | None = None) -> bool:
    fs, p = _fs(spark, f"{root}/{asset.key}")
    if not fs.exists(p) or city is None:
        return fs.exists(p)
    return not _whole(spark, root, asset).where(F.col("city") == city).limit(1).isEmpty()


def _parts_schema(asset: Asset) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in asset.parts])


def _whole(spark: SparkSession, root: str, asset: Asset) -> DataFrame:
    """All rows with the partition columns."""
    schema = T.StructType(asset.schema.fields + _parts_schema(asset).fields)
    if not has_data(spark, root, asset):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{asset.key}")


def scan(spark: SparkSession, root: str, asset: Asset, cities: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Rows of an asset; both bounds (text, date or datetime) are inclusive. City and month become
    predicates on the partition columns too, so other folders aren't read. No data: an empty table of
    the schema."""
    d = _whole(spark, root, asset)
    if cities is not None:
        d = d.where(F.col("city").isin(cities) & F.col("city_id").isin(cities))
    for bound, op in ((start, "__ge__"), (end, "__le__")):
        if bound is not None and asset.time:
            kind = "date" if asset.columns[asset.time] == "date" else "timestamp_ntz"
            text = bound if isinstance(bound, str) else bound.isoformat()
            d = d.where(getattr(F.col(asset.time), op)(F.lit(text).cast(kind)) & getattr(F.concat("year", "month"), op)(F.lit(text[:4] + text[5:7])))
    return d.select(*asset.columns)


def read_partition(spark: SparkSession, root: str, asset: Asset, city: str, year: int | None = None, month: int | None = None) -> DataFrame:
    """Rows of one partition; empty if there is none."""
    d = _whole(spark, root, asset).where(F.col("city") == city)
    if asset.time and year is not None and month is not None:
        d = d.where((F.col("year") == f"{year:04d}") & (F.col("month") == f"{month:02d}"))
    return d.select(*asset.columns)


def _leaves(fs, path, depth: int) -> list:
    """Paths of the folders ``depth`` levels below, of names with an equals sign."""
    found = [x.getPath() for x in fs.listStatus(path) if x.isDirectory() and "=" in x.getPath().getName()]
    return found if depth == 1 else [y for x in found for y in _leaves(fs, x, depth - 1)]


def _rename(fs, a, b) -> None:
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"can't rename {a} to {b}")


def _swap(fs, pairs: list[tuple]) -> None:
    """Put each new folder in the place of its target and the old one into its backup; if any step
    fails, everything moved so far goes back and the error goes on."""
    done = []
    try:
        for new, target, backup in pairs:
            if fs.exists(target):
                _rename(fs, target, backup)
                done.append((backup, target))
            _rename(fs, new, target)
            done.append((target, new))
    except Exception:
        for there, back in reversed(done):
            _rename(fs, there, back)
        raise


def _among(c: str, values: set) -> Column:
    """c is one of these values, of which None is one as well."""
    known = sorted(v for v in values if v is not None)
    hit = F.col(c).isin(known) if known else F.lit(False)
    return F.coalesce(hit, F.lit(None in values))


#: Partitions up to which a scan names each of them; beyond, each column's values.
MOST_NAMED = 500


def _exactly(parts: list[str], touched: list) -> Column:
    """Rows of these partitions: by each of them where they are few, else by the values of each column (a little more)."""
    if len(touched) <= MOST_NAMED:
        same = [reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(r[c])) if r[c] is None else F.col(c) == r[c] for c in parts)) for r in touched]
        return reduce(Column.__or__, same, F.lit(False))
    return reduce(Column.__and__, (_among(c, {r[c] for r in touched}) for c in parts))


REPORT = "asset_key string, rows_received bigint, rows_without_time bigint, rows_merged bigint, rows_written bigint, duplicates_removed bigint, partitions_written int, bytes_written bigint, missing_columns array<string>, extra_columns array<string>, earliest_data_time timestamp_ntz, latest_data_time timestamp_ntz, schema_hash string"


def upsert(df: DataFrame, root: str, asset: Asset) -> DataFrame:
    """Merge rows into the partitions they belong to, the last arrival of a key wins, and return the
    report (one row of REPORT). Touched partitions are written beside the table first and then swapped
    in; if a swap fails, the old ones are put back. Only touched partitions are read. Rows without a
    time are left out and counted; a batch that has no time at all is an error; an empty one writes
    nothing. A null city is a partition of its own. What the report counts is observed by the two writes; the rows that
    were there come from the footers of their files. A table has one writer at a time, and a reader may
    miss a partition in the moment of its swap."""
    spark = df.sparkSession
    new, missing, extra = aligned(df, asset)
    work = f"{root}/_work/{uuid.uuid4().hex}"
    fs, _ = _fs(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new = new.withColumns({"_at": F.lit(1), "_seq": F.monotonically_increasing_id(), "city": F.col("city_id")})
    if asset.time:
        new = new.withColumns({"year": F.date_format(asset.time, "yyyy"), "month": F.date_format(asset.time, "MM")})
    try:
        timed = F.col(asset.time).isNotNull() if asset.time else F.lit(True)
        stamp = F.col(asset.time).cast("timestamp_ntz") if asset.time else F.lit(None).cast("timestamp_ntz")
        arrived = Observation()
        new.observe(arrived, F.count("*").alias("n"), F.count_if(timed).alias("timed"), F.min(stamp).alias("earliest"), F.max(stamp).alias("latest")).write.parquet(f"{work}/new")
        received, good, earliest, latest = (arrived.get[k] for k in ("n", "timed", "earliest", "latest"))
        new = spark.read.schema(new.schema).parquet(f"{work}/new")
        if received and not good:
            raise ValueError(f"no row of {asset.key} has a valid {asset.time}")
        new = new.where(timed)
        touched = new.select(*asset.parts).distinct().collect()  # folders, not rows
        old = _whole(spark, root, asset).where(_exactly(asset.parts, touched))
        if len(touched) > MOST_NAMED:
            same = reduce(lambda a, b: a & b, (F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")) for c in asset.parts))
            old = old.alias("o").join(spark.createDataFrame(touched, _parts_schema(asset)).alias("t"), same, "left_semi")
        old = old.withColumns({"_at": F.lit(0), "_seq": F.lit(0).cast("long")})
        merged = keep_last(old.unionByName(new), list(asset.primary_key), ["_at", "_seq"]).drop("_at", "_seq")
        out = merged.repartition(*asset.parts).sortWithinPartitions(*asset.parts, *([asset.time] if asset.time else []))
        before, written, size, leaves = old.count(), 0, 0, []
        if good:
            put = Observation()
            out.observe(put, F.count("*").alias("n")).write.partitionBy(*asset.parts).option("compression", "zstd").parquet(f"{work}/out")
            written = put.get["n"]
            leaves = _leaves(fs, path(f"{work}/out"), len(asset.parts))
            size = sum(x.getLen() for leaf in leaves for x in fs.listStatus(leaf))
        inner = ["/".join(str(leaf).rsplit("/", len(asset.parts))[1:]) for leaf in leaves]
        _swap(fs, [(leaf, path(f"{root}/{asset.key}/{name}"), path(f"{work}/old/{name}")) for leaf, name in zip(leaves, inner, strict=True)])
    finally:
        fs.delete(path(work), True)
    return spark.createDataFrame([(asset.key, received, received - good, good, written, before + good - written, len(leaves), size, missing, sorted(set(extra) - INJECTED), earliest, latest, asset.schema_hash)], REPORT)


def partitions(spark: SparkSession, root: str, asset: Asset) -> DataFrame:
    """Partition values, file, bytes and modification time of every file of an asset, from a listing;
    no file is opened."""
    if not has_data(spark, root, asset):
        return spark.createDataFrame([], T.StructType(_parts_schema(asset).fields)).select("*", F.lit("").alias("file"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("timestamp").alias("modified"))
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{root}/{asset.key}")
    return d.select(*(F.col(c).cast("string").alias(c) if c == "city" else F.lpad(F.col(c).cast("string"), 2 if c == "month" else 4, "0").alias(c) for c in asset.parts), F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def dataset_stats(spark: SparkSession, root: str, asset: Asset) -> DataFrame:
    """One row: rows, bytes, files, partitions, cities, and the first and last time of an asset."""
    time = F.col(asset.time).cast("timestamp_ntz") if asset.time else F.lit(None).cast("timestamp_ntz")
    rows = scan(spark, root, asset).agg(F.count("*").alias("row_count"), F.min(time).alias("earliest_data_time"), F.max(time).alias("latest_data_time"))
    files = partitions(spark, root, asset).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("byte_size"), F.count("*").alias("file_count"), F.count_distinct(F.struct(*asset.parts)).alias("partition_count"), F.count_distinct("city").alias("city_count"))
    return rows.crossJoin(files).select(F.lit(asset.key).alias("asset_key"), "*")  # one row each


FILES = "asset_key string, place string, file string, bytes bigint, modified timestamp, city string, rows bigint, earliest timestamp_ntz, latest timestamp_ntz"


def file_stats(spark: SparkSession, root: str, asset: Asset, known: DataFrame | None = None) -> DataFrame:
    """Statistics of every file of an asset (FILES). Files that ``known`` (an earlier result) has with the same size and time are
    taken from there, others are read, and those that are gone are left out: what is read grows with what has changed. A file's
    ``place`` is its partition and name."""
    name = F.concat_ws("/", *(F.coalesce(F.col(c), F.lit("")) for c in asset.parts), F.element_at(F.split("file", "/"), -1))
    listed = partitions(spark, root, asset).withColumn("place", name)
    have = (known if known is not None else spark.createDataFrame([], FILES)).where(F.col("asset_key") == asset.key)
    same = ["place", "bytes", "modified"]
    kept = have.join(listed.select(*same), same, "left_semi").select(*(c.split()[0] for c in FILES.split(", ")))
    changed = listed.join(have.select(*same), same, "left_anti")
    paths = [r["file"] for r in changed.select("file").collect()]  # names of files
    if not paths:
        return kept
    time = F.col(asset.time).cast("timestamp_ntz") if asset.time else F.lit(None).cast("timestamp_ntz")
    schema = T.StructType(asset.schema.fields + _parts_schema(asset).fields)
    rows = spark.read.schema(schema).option("basePath", f"{root}/{asset.key}").parquet(*paths)
    rows = rows.select(F.concat_ws("/", *(F.coalesce(F.col(c), F.lit("")) for c in asset.parts), "_metadata.file_name").alias("place"), time.alias("t"))
    sums = rows.groupBy("place").agg(F.count("*").alias("rows"), F.min("t").alias("earliest"), F.max("t").alias("latest"))
    fresh = changed.join(sums, "place", "left").select(F.lit(asset.key).alias("asset_key"), "place", "file", "bytes", "modified", "city", F.coalesce("rows", F.lit(0)).alias("rows"), "earliest", "latest")
    return kept.unionByName(fresh)


def summed(files: DataFrame, asset: Asset) -> DataFrame:
    """The row of ``dataset_stats`` from the statistics of an asset's files."""
    folder = F.regexp_replace("place", "/[^/]*$", "")
    d = files.where(F.col("asset_key") == asset.key).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"), F.min("earliest").alias("earliest_data_time"), F.max("latest").alias("latest_data_time"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("byte_size"), F.count("*").alias("file_count"), F.count_distinct(folder).alias("partition_count"), F.count_distinct("city").alias("city_count"))
    return d.select(F.lit(asset.key).alias("asset_key"), "*")


def rows_of(columnar: DataFrame, variables: dict[str, str], payload: str = "body") -> DataFrame:
    """Rows of columnar JSON ({"hourly": {"time": [...], "v": [...]}}); short arrays end in nulls."""
    kinds = ", ".join(f"{v}: array<{t}>" for v, t in {"time": "string", **variables}.items())
    d = columnar.withColumn("h", F.from_json(payload, f"hourly struct<{kinds}>")["hourly"])
    rest = [c for c in columnar.columns if c != payload]
    return d.select(*rest, F.inline(F.arrays_zip(*(F.col(f"h.{v}").alias(v) for v in ["time", *variables]))))
