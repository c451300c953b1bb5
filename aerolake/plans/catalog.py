"""The catalog as small tables: assets, columns, cities, runs, results, scores and versions.

assets: asset_key, name, domain, layer, status, owner, description, tags, sla_minutes, time_column. columns:
asset_key, place, name, type, unit, description. runs: run_id, job, asset_key, city_id, status, trigger, started_at,
finished_at, rows_read, rows_written, bytes_written, error. results: asset_key, check, dimension, severity, status,
score, evaluated_at. scores: asset_key, scored_at, total, grade. versions: asset_key, version, run_id, snapshot_at,
row_count, byte_size, file_count, city_count, schema_hash. Each is a folder of Parquet files to which rows are only
appended; the newest row of a key counts. Tables that aren't there yet are empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolake.functions import scalars
from aerolake.operators import patterns
from aerolake.plans import quality
from aerolake.sources import lake

SCHEMAS = {
    "assets": "asset_key string, name string, domain string, layer string, status string, owner string, description string, tags array<string>, sla_minutes int, time_column string, schema_hash string",
    "columns": "asset_key string, place int, name string, type string, unit string, description string, nullable boolean, is_key boolean",
    "cities": "city_id string, name string, country string, latitude double, longitude double, timezone string, active boolean, tags array<string>",
    "runs": "run_id string, job string, asset_key string, city_id string, status string, trigger string, started_at timestamp_ntz, finished_at timestamp_ntz, rows_read bigint, rows_written bigint, bytes_written bigint, error string",
    "results": "asset_key string, check string, dimension string, severity string, status string, score double, evaluated_at timestamp_ntz",
    "scores": "asset_key string, scored_at timestamp_ntz, total double, grade string",
    "versions": "asset_key string, version string, run_id string, snapshot_at timestamp_ntz, row_count bigint, byte_size bigint, file_count bigint, city_count bigint, schema_hash string",
}


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    fs, p = lake._fs(spark, f"{root}/{table}")
    return spark.read.schema(SCHEMAS[table]).parquet(f"{root}/{table}") if fs.exists(p) else spark.createDataFrame([], SCHEMAS[table])


def append(df: DataFrame, root: str, table: str) -> None:
    """Rows as the table has them; columns it lacks are dropped, missing ones are null."""
    want = df.sparkSession.createDataFrame([], SCHEMAS[table]).schema
    df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want)).write.mode("append").parquet(f"{root}/{table}")


# --- configuration ------------------------------------------------------------------------------------


def load_config(path: str | Path) -> dict:
    """A YAML file of the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def assets_of(config: dict) -> list[lake.Asset]:
    """Assets of a configuration (assets: key, name, columns, primary_key, time, ...), checked: types, keys and
    time columns that exist, ranges in order, no key or column twice."""
    out = []
    for a in config.get("assets", []):
        columns, info = {}, {}
        for c in a["columns"]:
            if c["name"] in columns:
                raise ValueError(f"{a['key']}: column {c['name']} twice")
            if c["type"] not in lake.TYPES:
                raise ValueError(f"{a['key']}.{c['name']}: no type {c['type']}")
            lo, hi = c.get("range") or (0, 0)
            if lo > hi:
                raise ValueError(f"{a['key']}.{c['name']}: range {lo} to {hi}")
            columns[c["name"]], info[c["name"]] = c["type"], {k: v for k, v in c.items() if k not in ("name", "type")}
        key, time = tuple(a.get("primary_key", ())), a.get("time")
        if missing := [c for c in (*key, *([time] if time else [])) if c not in columns]:
            raise ValueError(f"{a['key']}: no columns {missing}")
        rest = {k: a[k] for k in ("name", "domain", "layer", "owner", "status", "description", "granularity", "sla_minutes") if k in a}
        out.append(lake.Asset(a["key"], columns, key, time, tags=tuple(a.get("tags", ())), info=info, **rest))
    if len({a.key for a in out}) < len(out):
        raise ValueError("an asset key twice")
    return out


def asset_rows(spark: SparkSession, assets: Iterable[lake.Asset]) -> DataFrame:
    return spark.createDataFrame([(a.key, a.name or a.key, a.domain, a.layer, a.status, a.owner, a.description, list(a.tags), a.sla_minutes, a.time, a.schema_hash) for a in assets], SCHEMAS["assets"])


def column_rows(spark: SparkSession, assets: Iterable[lake.Asset]) -> DataFrame:
    rows = [(a.key, i, c, t, a.info.get(c, {}).get("unit"), a.info.get(c, {}).get("description"), a.info.get(c, {}).get("nullable", True), c in a.primary_key) for a in assets for i, (c, t) in enumerate(a.columns.items())]
    return spark.createDataFrame(rows, SCHEMAS["columns"])


# --- search and details -----------------------------------------------------------------------------------


def search(assets: DataFrame, columns: DataFrame, text: str | None = None, **equal: str | None) -> DataFrame:
    """Assets with these domain, layer, status and owner whose key, name, description, tags or column names hold
    the text, whatever its case; in the order of layer and key."""
    for c, v in equal.items():
        if c not in ("domain", "layer", "status", "owner"):
            raise ValueError(f"no filter {c}")
        if v:
            assets = assets.where(F.col(c) == v)
    if text and text.strip():
        hit = lambda c: scalars.contains_text(c, text)
        own = hit(F.col("asset_key")) | hit(F.col("name")) | hit(F.col("description")) | F.exists(F.coalesce("tags", F.array().cast("array<string>")), hit)
        named = columns.where(hit(F.col("name"))).select("asset_key").distinct().withColumn("_named", F.lit(True))
        assets = assets.join(named, "asset_key", "left").where(own | F.col("_named")).drop("_named")
    return assets.orderBy("layer", "asset_key")


def newest(df: DataFrame, by: list[str], time: str, n: int, ties: list[str] | None = None) -> DataFrame:
    """The n newest rows of each group, the newest first."""
    w = Window.partitionBy(*by).orderBy(F.col(time).desc_nulls_last(), *(ties or []))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).orderBy(*by, "_k").drop("_k")


def open_issues(results: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """asset_key and open_issues: failed and warning results of the last hours."""
    since = now - F.make_dt_interval(hours=F.lit(hours))
    return results.where(F.col("status").isin("failed", "warning") & (F.col("evaluated_at") >= since)).groupBy("asset_key").agg(F.count("*").alias("open_issues"))


def details(assets: DataFrame, versions: DataFrame, runs: DataFrame, scores: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Each asset with its newest version, its newest score, runs and issues, freshness and number of versions;
    dictionary, the 10 newest versions and runs are ``columns`` and ``newest``."""
    last = patterns.latest(versions.withColumnRenamed("schema_hash", "version_hash"), [F.col("snapshot_at").desc_nulls_last(), F.col("version").desc()], ["asset_key"]).drop("run_id")
    score = patterns.latest(scores, [F.col("scored_at").desc_nulls_last(), F.col("total").desc()], ["asset_key"])
    ran = runs.groupBy("asset_key").agg(F.count("*").alias("runs"), F.max("started_at").alias("latest_run_at"))
    d = assets.join(last, "asset_key", "left").join(score, "asset_key", "left").join(ran, "asset_key", "left").join(open_issues(results, now), "asset_key", "left")
    return d.fillna(0, ["runs", "open_issues"])


def city_list(cities: DataFrame, runs: DataFrame, active_only: bool = False) -> DataFrame:
    """Cities by key with has_data: whether a run of theirs succeeded."""
    done = runs.where("status = 'success'").select("city_id").distinct().withColumn("_done", F.lit(True))
    d = cities.where("active") if active_only else cities
    return d.join(done, "city_id", "left").withColumn("has_data", F.coalesce("_done", F.lit(False))).drop("_done").orderBy("city_id")


def run_cities(cities: DataFrame, asked: list[str] | None = None, most: int = 20) -> DataFrame:
    """The first ``most`` cities of a run by key: those asked for, or the active ones (a limit of requests)."""
    d = cities.where(F.col("city_id").isin(asked)) if asked else cities.where("active")
    return d.orderBy("city_id").limit(most)


def recent_runs(runs: DataFrame, assets: DataFrame, cities: DataFrame, n: int = 50, **equal: str | None) -> DataFrame:
    """The n newest runs with names of asset and city."""
    for c, v in equal.items():
        if v:
            runs = runs.where(F.col(c) == v)
    top = runs.orderBy(F.col("started_at").desc_nulls_last(), "run_id", "city_id").limit(n)
    d = top.join(assets.select("asset_key", F.col("name").alias("asset_name")), "asset_key", "left").join(cities.select("city_id", F.col("name").alias("city_name")), "city_id", "left")
    return d.orderBy(F.col("started_at").desc_nulls_last(), "run_id", "city_id")


def score_history(scores: DataFrame, asset_key: str, n: int = 60) -> DataFrame:
    """The n newest scores of an asset, the oldest first."""
    return scores.where(F.col("asset_key") == asset_key).orderBy(F.desc("scored_at")).limit(n).orderBy("scored_at")


def recent_results(results: DataFrame, n: int = 100, **equal: str | None) -> DataFrame:
    """The n newest results of an asset, status or dimension."""
    for c, v in equal.items():
        if v:
            results = results.where(F.col(c) == v)
    return results.orderBy(F.col("evaluated_at").desc_nulls_last(), "asset_key", "check").limit(n)


def overview(assets: DataFrame, scores: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """kpi and value: assets, breached agreements, mean score, grades, runs of the last day and their success.
    assets come with latest_data_time and latest_run_at. Of an asset's newest scores the highest counts, of several
    such the first grade, so that the grades don't depend on how rows are dealt out."""
    state = quality.freshness_state(assets, now)
    last = patterns.latest(scores, [F.col("scored_at").desc_nulls_last(), F.col("total").desc(), F.col("grade").asc_nulls_last()], ["asset_key"])
    day = runs.where(F.col("started_at") >= now - F.expr("INTERVAL 24 HOUR"))
    rows = lambda d, kpi, value: d.select(kpi.alias("kpi"), value.cast("double").alias("value"))
    one = state.agg(F.count("*").alias("a"), F.count_if(F.col("breached") & (F.col("status") == "active")).alias("b"))
    ran = day.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("s"))
    parts = [
        rows(one, F.lit("assets"), F.col("a")), rows(one, F.lit("sla_breaches"), F.col("b")), rows(last.agg(F.round(F.avg("total"), 2).alias("v")), F.lit("avg_quality_score"), F.col("v")),
        rows(ran, F.lit("runs_24h"), F.col("n")), rows(ran, F.lit("success_rate_24h"), F.round(F.try_divide(100.0 * F.col("s"), F.col("n")), 1)),
        rows(state.groupBy("layer").count(), F.concat(F.lit("layer:"), "layer"), F.col("count")), rows(state.groupBy("domain").count(), F.concat(F.lit("domain:"), "domain"), F.col("count")),
        rows(last.groupBy("grade").count(), F.concat(F.lit("grade:"), "grade"), F.col("count")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


# --- statistics and retention -----------------------------------------------------------------------------


def snapshot(spark: SparkSession, lake_root: str, catalog_root: str, asset: lake.Asset, now, run_id: str | None = None) -> DataFrame:
    """Statistics of an asset's files as a new row of versions, which is returned. The statistics by file stay beside the catalog
    under the version's name, so that the next snapshot reads only files that are new or have changed."""
    t = F.lit(str(now)).cast("timestamp_ntz")
    folder = lambda version: f"{catalog_root}/_files/{asset.key}/{version}"
    last = read(spark, catalog_root, "versions").where(F.col("asset_key") == asset.key).orderBy(F.desc("snapshot_at"), F.desc("version")).select("version").first()
    fs, path = lake._fs(spark, catalog_root)[0], spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    known = spark.read.schema(lake.FILES).parquet(folder(last["version"])) if last and fs.exists(path(folder(last["version"]))) else None
    version = spark.range(1).select(F.concat(F.lit("snap-"), F.date_format(t, "yyyyMMdd'T'HHmmss"))).first()[0]
    if last and last["version"] == version:  # twice in a second: its own statistics are being read
        version += f"-{uuid.uuid4().hex[:8]}"
    lake.file_stats(spark, lake_root, asset, known).write.mode("overwrite").parquet(folder(version))
    s = lake.summed(spark.read.schema(lake.FILES).parquet(folder(version)), asset)
    row = s.select("asset_key", F.lit(version).alias("version"), F.lit(run_id).alias("run_id"), t.alias("snapshot_at"), "row_count", "byte_size", "file_count", "city_count", F.lit(asset.schema_hash).alias("schema_hash"), "latest_data_time")
    row = spark.createDataFrame(row.collect(), row.schema)  # one row
    append(row, catalog_root, "versions")
    if known is not None:
        fs.delete(path(folder(last["version"])), True)
    return row


#: Tables with a limit of age, and the column that tells it.
AGED = {"runs": "started_at", "results": "evaluated_at", "scores": "scored_at"}


def outdated(df: DataFrame, table: str, cutoff: Column) -> DataFrame:
    """Rows of a table older than the cutoff; the newest score of an asset is never outdated."""
    if table != "scores":
        return df.where(F.col(AGED[table]) < cutoff)
    newest_of = df.groupBy("asset_key").agg(F.max("scored_at").alias("_newest"))
    return df.join(newest_of, "asset_key").where((F.col("scored_at") < cutoff) & (F.col("scored_at") < F.col("_newest"))).drop("_newest")


def _replace(df: DataFrame, root: str, table: str) -> None:
    """Write df beside a table and swap it in; the old one is back if that fails."""
    spark, work = df.sparkSession, f"{root}/_work_{uuid.uuid4().hex}"
    fs, _ = lake._fs(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    try:
        df.write.parquet(f"{work}/new")
        lake._swap(fs, [(path(f"{work}/new"), path(f"{root}/{table}"), path(f"{work}/old"))])
    finally:
        fs.delete(path(work), True)


def _current_scores(df: DataFrame, cutoff: Column) -> DataFrame:
    """The scores that aren't outdated."""
    d = df.join(df.groupBy("asset_key").agg(F.max("scored_at").alias("_newest")), "asset_key", "left")
    return d.where(~F.coalesce((F.col("scored_at") < cutoff) & (F.col("scored_at") < F.col("_newest")), F.lit(False))).select(df.columns)


def prune(spark: SparkSession, root: str, now, days: int = 90, dry_run: bool = True) -> DataFrame:
    """table, rows and pruned of the aged tables. Without ``dry_run`` what stays is written beside a table and
    swapped in for it, and back if that fails."""
    if days < 1:
        raise ValueError("days to keep must be positive")
    cutoff = F.lit(str(now)).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    report = []
    for table in AGED:
        df = read(spark, root, table)
        total, old = df.count(), outdated(df, table, cutoff).count()
        if old and not dry_run:
            stay = _current_scores(df, cutoff) if table == "scores" else df.where(~F.coalesce(F.col(AGED[table]) < cutoff, F.lit(False)))
            _replace(stay, root, table)
        report.append((table, total, old))
    return spark.createDataFrame(report, "table string, rows bigint, pruned bigint")


def prune_exports(spark: SparkSession, folder: str, now, days: int = 7, dry_run: bool = True) -> DataFrame:
    """file and bytes of the exported files that were changed before; deleted without ``dry_run``."""
    fs, p = lake._fs(spark, folder)
    if not fs.exists(p):
        return spark.createDataFrame([], "file string, bytes bigint")
    cutoff = F.lit(str(now)).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    old = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("modificationTime") < cutoff).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    rows = [(r["file"], r["bytes"]) for r in old.collect()]  # exports that somebody asked for
    if not dry_run:
        for f, _ in rows:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f), False)
    return spark.createDataFrame(rows, "file string, bytes bigint")


def sync_table(spark: SparkSession, root: str, table: str, want: DataFrame, keys: list[str], deactivate: str | None = None) -> DataFrame:
    """Bring a table of the catalog to the wanted rows by key and return action and n: created, updated, kept,
    and deleted, or deactivated where ``deactivate`` names the flag."""
    have, columns = read(spark, root, table), [c for c in want.columns if c not in keys]
    h = have.select(*keys, F.struct(*columns).alias("old"), F.lit(True).alias("_h"))
    w = want.select(*keys, F.struct(*columns).alias("new"), F.lit(True).alias("_w"))
    d = h.join(w, keys, "full_outer")
    text = lambda c: F.to_json(c)
    d = d.withColumn("action", F.when(F.col("_h").isNull(), "create").when(F.col("_w").isNull(), "deactivate" if deactivate else "delete").when(text(F.col("old")).eqNullSafe(text(F.col("new"))), "keep").otherwise("update"))
    rows = d.where("action <> 'delete'").select(*keys, "action", F.coalesce("new", "old").alias("r")).select(*keys, "action", "r.*")
    if deactivate:
        rows = rows.withColumn(deactivate, F.when(F.col("action") == "deactivate", F.lit(False)).otherwise(F.col(deactivate)))
    report = d.groupBy("action").agg(F.count("*").alias("n"))
    report = spark.createDataFrame(report.collect(), report.schema)  # an action a row
    _replace(rows.select(*want.columns), root, table)
    return report


def bootstrap(spark: SparkSession, root: str, assets: list[lake.Asset], cities: DataFrame) -> dict[str, DataFrame]:
    """Bring assets, columns and cities of the catalog to the configuration; cities that are gone are kept
    inactive."""
    return {
        "assets": sync_table(spark, root, "assets", asset_rows(spark, assets), ["asset_key"]),
        "columns": sync_table(spark, root, "columns", column_rows(spark, assets), ["asset_key", "name"]),
        "cities": sync_table(spark, root, "cities", cities, ["city_id"], "active"),
    }
