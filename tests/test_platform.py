"""Catalog, exports, jobs, sources, episodes, clusters and scalars on small literal inputs."""

import datetime as dt
import json
import re
import shutil

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from aerolake.functions import scalars
from aerolake.functions import standards as S
from aerolake.operators import patterns, similar, stats
from aerolake.plans import catalog, derive, episodes, insights, jobs, quality, read_model
from aerolake.sinks import exports
from aerolake.sources import endpoints, lake
from aerolake.sources import query as reading
from aerolake.streaming.ingest import live_coverage

NOW = dt.datetime(2026, 1, 10, 12)
POLLUTANTS = "pm2_5 pm10 ozone nitrogen_dioxide sulphur_dioxide carbon_monoxide".split()


def test_episode_of_the_seeded_set(spark):
    """Rows 100 to 129 of one city are spiked; means of 24 rows stretch the episode to rows 108 to 144."""
    rows = []
    for c in ("beijing", "shanghai"):
        for i in range(240):
            spike = c == "beijing" and 100 <= i < 130
            pm = 180.0 if spike else 18 + 6 * float(np.sin(i * np.pi / 12))
            rows.append((c, dt.datetime(2026, 1, 1) + dt.timedelta(hours=i), pm, 220.0 if spike else 1.6 * pm, 60.0, 25.0, 8.0, 300.0, 130.0 if spike else 25 + 8 * float(np.sin(i * np.pi / 12)), 18.0, 60.0, 2.0 if spike else 6 + 4 * (i % 12) / 11, 0.0))
    cols = ", ".join(f"{c} double" for c in [*POLLUTANTS, "european_aqi", "temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation"])
    d = spark.createDataFrame(rows, f"city_id string, time timestamp_ntz, {cols}")
    h = derive.hourly(d)
    assert h.where("city_id = 'beijing'").orderBy("time").first()["china_aqi"] == 31.25
    (e,) = episodes.episodes(h).collect()
    at = lambda t: int((t - dt.datetime(2026, 1, 1)).total_seconds() // 3600)
    assert (e["city_id"], at(e["start_time"]), at(e["end_time"]), e["duration"], e["peak"], at(e["peak_time"]), e["window_share"], e["chronic"]) == ("beijing", 108, 144, 37, 230.0, 123, 15.4, False)
    assert abs(e["mean"] - 177.2) < 0.1 and e["severity"] == "严重" and e["peak_level"] == "重度污染" and e["primary_pollutant"] == "PM2.5"
    t = episodes.totals(episodes.episodes(h)).first()
    assert (t["episodes"], t["hours"], t["worst_city"]) == (1, 37, "beijing")
    assert episodes.totals(episodes.episodes(h.limit(0))).first()["episodes"] == 0


def test_ranked_with_ties_and_nulls(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate([5.0, 1.0, 5.0, None, 3.0, 9.0, None])], "i int, v double")
    got = {r["i"]: r["place"] for r in patterns.ranked(d, "v", [F.col("i").asc()], "place", 4).collect()}
    assert got == {5: 1, 0: 2, 2: 3, 4: 4, 1: 5, 3: 6, 6: 7}
    assert patterns.ranked(d.limit(0), "v", [F.col("i").asc()], "place").count() == 0


def test_labels(spark):
    d = spark.createDataFrame([(x,) for x in (0.9, -0.7, 0.4, -0.2, 0.1, None)], "r double")
    assert [r[0] for r in d.select(S.correlation_label(F.col("r"))).collect()] == ["极强正相关", "强负相关", "中等正相关", "弱负相关", "几乎无", "样本不足"]
    p = spark.createDataFrame([(350.0, 1), (180.0, 5), (120.0, 2), (60.0, 3)], "peak double, h int")
    assert [r[0] for r in p.select(S.severity(F.col("peak"), F.col("h"))).collect()] == ["严重", "较重", "中等", "轻微"]
    one = spark.range(1)
    assert one.select(S.aqi_color(F.lit(None).cast("double"))).first()[0] == "#94a3b8" and one.select(S.china_advice(F.lit("优"))).first()[0].startswith("空气质量令人满意")
    s = [r[0] for r in spark.createDataFrame([(v,) for v in (1.0, 0.99, 0.97, 0.95, None)], "v double").select(S.linear_score(F.col("v"), 0.99, 0.95)).collect()]
    assert s == [100.0, 100.0, 50.0, 0.0, None]


def test_scalars(spark):
    assert scalars.slugify("São Paulo (Zentrum) ") == "sao-paulo-zentrum" and scalars.canonical({"b": 1, "a": [None]}) == '{"a":[null],"b":1}'
    assert scalars.deep_merge({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}, "b": 1}
    r = spark.range(1).select(
        scalars.slug(F.lit("São  Paulo!")).alias("slug"), scalars.short_label(F.lit("气温（2米）"), F.lit("t")).alias("label"), scalars.short_label(F.lit(""), F.lit("t")).alias("name"),
        scalars.parse_time(F.lit("2026-01-01T10:00Z")).alias("t"), scalars.parse_time(F.lit("soon")).alias("bad"), scalars.months_of(F.lit("2025-12-31").cast("date"), F.lit("2026-02-01").cast("date")).alias("months"),
        scalars.days_of(F.lit("2026-01-02").cast("date"), F.lit("2026-01-01").cast("date")).alias("none"), scalars.chunks(F.lit([1, 2, 3, 4, 5]), 2).alias("chunks"), scalars.cell(F.lit([1, 2]), "array<int>").alias("cell"), scalars.cell(F.lit(None).cast("int"), "int").alias("empty"), scalars.row_hash("id", length=8).alias("hash"),
    ).first()
    assert (r["slug"], r["label"], r["name"], r["t"], r["bad"]) == ("sao-paulo", "气温", "t", dt.datetime(2026, 1, 1, 10), None)
    assert (r["months"], r["none"], r["chunks"], r["cell"], r["empty"], len(r["hash"])) == (["2025-12", "2026-01", "2026-02"], [], [[1, 2], [3, 4], [5]], "[1,2]", "", 8)


def test_reading_checks_names(spark):
    d = spark.createDataFrame([("a", NOW, 1.0), ("b", None, float("nan"))], "city_id string, time timestamp_ntz, v double")
    for bad in (["v; DROP"], ["nope"]):
        with pytest.raises(ValueError):
            reading.fetch(d, bad)
    with pytest.raises(ValueError):
        reading.aggregate(d, "city_id", {"v": ["evil"]})
    assert reading.required(d, ["v"]).count() == 1 and reading.time_column(d) == "time" and reading.known_metrics(["ozone", "x"]) == ["ozone"]
    assert reading.daily_column(["temp_avg", "ozone_8h_max"], "temperature_2m") == "temp_avg" and reading.daily_column(["gust_max"], "gust") == "gust_max" and reading.daily_column([], "x") is None
    c = spark.createDataFrame([("a", True), ("b", False)], "city_id string, active boolean")
    assert reading.resolve(c, ["a", "zz"]).count() == 1 and reading.resolve(c, None).count() == 1
    with pytest.raises(ValueError):
        reading.resolve(c, ["zz"], strict=True)


CONFIG = {"assets": [{"key": "air", "name": "Air", "layer": "raw", "domain": "air", "owner": "o", "primary_key": ["city_id", "time"], "time": "time", "tags": ["Smog"], "sla_minutes": 60, "columns": [{"name": "city_id", "type": "string"}, {"name": "time", "type": "timestamp"}, {"name": "pm2_5", "type": "double", "unit": "µg", "range": [0, 10]}]}]}


def test_catalog_from_config_to_prune(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(json.dumps(CONFIG))
    (asset,) = catalog.assets_of(catalog.load_config(tmp_path / "c.yaml"))
    for broken in ({"type": "blob", "name": "x"}, {"type": "double", "name": "pm2_5"}, {"type": "double", "name": "x", "range": [2, 1]}):
        with pytest.raises(ValueError):
            catalog.assets_of({"assets": [CONFIG["assets"][0] | {"columns": [*CONFIG["assets"][0]["columns"], broken]}]})
    root, lake_root = str(tmp_path / "cat"), str(tmp_path / "lake")
    city = lambda rows: spark.createDataFrame(rows, "city_id string, name string, country string, latitude double, longitude double, timezone string, active boolean, tags array<string>")
    first = catalog.bootstrap(spark, root, [asset], city([("a", "A", None, 1.0, 1.0, "UTC", True, []), ("b", "B", None, 1.0, 1.0, "UTC", True, [])]))
    assert {r["action"]: r["n"] for r in first["cities"].collect()} == {"create": 2} and first["columns"].first()["n"] == 3
    again = catalog.bootstrap(spark, root, [asset], city([("a", "A2", None, 1.0, 1.0, "UTC", True, [])]))
    assert {r["action"]: r["n"] for r in again["cities"].collect()} == {"update": 1, "deactivate": 1} and again["assets"].first()["action"] == "keep"
    assert sorted((r["city_id"], r["name"], r["active"]) for r in catalog.read(spark, root, "cities").collect()) == [("a", "A2", True), ("b", "B", False)]
    assets, columns = catalog.read(spark, root, "assets"), catalog.read(spark, root, "columns")
    assert [catalog.search(assets, columns, t).count() for t in ("PM2", "smog", "nothing", "  ")] == [1, 1, 0, 1] and catalog.search(assets, columns, layer="served").count() == 0
    with pytest.raises(ValueError):
        catalog.search(assets, columns, secret="x")
    lake.upsert(spark.createDataFrame([("a", "2026-01-01T00:00", 1.0)], "city_id string, time string, pm2_5 double"), lake_root, asset)
    v = catalog.snapshot(spark, lake_root, root, asset, NOW, "r1").first()
    assert (v["row_count"], v["file_count"], v["version"]) == (1, 1, "snap-20260110T120000") and catalog.read(spark, root, "versions").count() == 1
    old, new = NOW - dt.timedelta(days=200), NOW - dt.timedelta(days=1)
    catalog.append(spark.createDataFrame([("r0", "air", "success", old), ("r1", "air", "failed", new), ("r2", "air", "failed", None)], "run_id string, asset_key string, status string, started_at timestamp_ntz"), root, "runs")
    catalog.append(spark.createDataFrame([("air", old, 50.0), ("air", old - dt.timedelta(days=1), 40.0), ("dust", old, 10.0)], "asset_key string, scored_at timestamp_ntz, total double"), root, "scores")
    want = {"runs": (3, 1), "results": (0, 0), "scores": (3, 1)}
    for dry in (True, False):
        assert {r["table"]: (r["rows"], r["pruned"]) for r in catalog.prune(spark, root, NOW, 90, dry).collect()} == want
    assert catalog.read(spark, root, "runs").count() == 2 and sorted(r["total"] for r in catalog.read(spark, root, "scores").collect()) == [10.0, 50.0]
    (tmp_path / "ex").mkdir()
    (tmp_path / "ex/a.csv").write_text("x")
    assert catalog.prune_exports(spark, str(tmp_path / "ex"), "2000-01-01").count() == 0
    assert catalog.prune_exports(spark, str(tmp_path / "ex"), "2100-01-01", dry_run=False).first()["bytes"] == 1 and not (tmp_path / "ex/a.csv").exists()


def test_snapshots_read_what_has_changed(spark, tmp_path):
    """Statistics by file: unchanged files are taken over, changed ones read, removed ones left out; equal to a full scan."""
    (asset,) = catalog.assets_of(CONFIG)
    root, lake_root = str(tmp_path / "cat"), str(tmp_path / "lake")
    rows = lambda cities, month, v: spark.createDataFrame([(c, f"2026-{month:02d}-{d:02d}T00:00", v) for c in cities for d in range(1, 6)], "city_id string, time string, pm2_5 double")
    full = lambda: tuple(lake.dataset_stats(spark, lake_root, asset).first())
    assert lake.summed(lake.file_stats(spark, lake_root, asset), asset).first()["row_count"] == 0
    lake.upsert(rows(["a", "b/c", "d é"], 1, 1.0).unionAll(rows(["a"], 2, 1.0)), lake_root, asset)
    held = lambda d: spark.createDataFrame(d.collect(), lake.FILES)  # noqa: E731  as a snapshot has it
    first = held(lake.file_stats(spark, lake_root, asset))
    assert first.count() == 4 and tuple(lake.summed(first, asset).first()) == full()
    lake.upsert(rows(["b/c"], 1, 2.0).limit(3), lake_root, asset)
    second = held(lake.file_stats(spark, lake_root, asset, first))
    same = second.join(first.select("place", "modified"), ["place", "modified"], "left_semi")
    assert same.count() == 3 and tuple(lake.summed(second, asset).first()) == full()
    # Only the changed file is read: what is known of the others comes from the table, even where it is wrong.
    lied = first.withColumn("rows", F.lit(1000).cast("bigint"))
    assert lake.summed(lake.file_stats(spark, lake_root, asset, lied), asset).first()["row_count"] == 3000 + 5
    shutil.rmtree(next((tmp_path / "lake").glob("*/city=a/year=2026/month=02")))
    third = lake.file_stats(spark, lake_root, asset, second)
    assert third.count() == 3 and tuple(lake.summed(third, asset).first()) == full()
    v1 = catalog.snapshot(spark, lake_root, root, asset, NOW).first()
    v2 = catalog.snapshot(spark, lake_root, root, asset, NOW).first()
    assert v1["row_count"] == v2["row_count"] == 15 and v1["version"] != v2["version"]
    assert len(list((tmp_path / "cat/_files").glob("*/*"))) == 1


def test_upserts_read_touched_partitions_alone(spark, tmp_path):
    """(A, 1) and (B, 2) don't touch (A, 2) and (B, 1)."""
    (asset,) = catalog.assets_of(CONFIG)
    root = str(tmp_path)
    rows = [(c, f"2026-0{m}-01T00:00", 1.0) for c in "AB" for m in (1, 2)]
    make = lambda r: spark.createDataFrame(r, "city_id string, time string, pm2_5 double")
    lake.upsert(make(rows), root, asset)
    d = lake._whole(spark, root, asset).where(lake._exactly(asset.parts, [{"city": "A", "year": "2026", "month": "01"}, {"city": "B", "year": "2026", "month": "02"}]))
    assert sorted((r["city"], r["month"]) for r in d.collect()) == [("A", "01"), ("B", "02")]
    assert re.search(r"PartitionFilters: \[.*\bOR\b", d._jdf.queryExecution().executedPlan().toString())
    r = lake.upsert(make([rows[0], rows[3], ("A", None, 2.0)]), root, asset).first()
    assert (r["rows_received"], r["rows_without_time"], r["rows_merged"], r["rows_written"], r["duplicates_removed"], r["partitions_written"]) == (3, 1, 2, 2, 2, 2)


def test_overview_of_tied_scores(spark):
    assets = spark.createDataFrame([("a", "raw", "air", "active", 60, "time", NOW, NOW)], "asset_key string, layer string, domain string, status string, sla_minutes int, time_column string, latest_data_time timestamp_ntz, latest_run_at timestamp_ntz")
    runs = spark.createDataFrame([("success", NOW)], "status string, started_at timestamp_ntz")
    scores = [("a", NOW, 90.0, g) for g in ("B", "A", None, "C")] + [("a", NOW, 80.0, "A0"), ("a", None, 99.0, "A0"), ("b", NOW, None, "D"), ("b", NOW, 10.0, "E")]
    for rows in (scores, scores[::-1]):
        s = spark.createDataFrame(rows, "asset_key string, scored_at timestamp_ntz, total double, grade string").coalesce(1)
        got = {r["kpi"]: r["value"] for r in catalog.overview(assets, s, runs, F.lit(str(NOW)).cast("timestamp_ntz")).collect()}
        assert got == {"assets": 1, "sla_breaches": 0, "avg_quality_score": 50, "runs_24h": 1, "success_rate_24h": 100, "layer:raw": 1, "domain:air": 1, "grade:A": 1, "grade:E": 1}


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([(f"c{i}", dt.datetime(2026, 1, 1, i), [i], None if i == 2 else 1.5) for i in range(4)], "city_id string, time timestamp_ntz, tags array<int>, v double")
    exports.csv(d, str(tmp_path / "csv"), 3)
    (f,) = (tmp_path / "csv").glob("*.csv")
    lines = f.read_text(encoding="utf-8").splitlines()
    assert lines[0] == "﻿city_id,time,tags,v" and [x.split(",")[0] for x in lines[1:]] == ["c1", "c2", "c3"] and lines[2].endswith("[2],")
    exports.json_lines(d, str(tmp_path / "json"), 2)
    (f,) = (tmp_path / "json").glob("*.json")
    assert [json.loads(x)["v"] for x in f.read_text().splitlines()] == [None, 1.5]
    with pytest.raises(ValueError):
        exports.csv(d, str(tmp_path / "no"), 200_001)
    (asset,) = catalog.assets_of(CONFIG)
    a, c = catalog.asset_rows(spark, [asset]), catalog.column_rows(spark, [asset])
    doc = json.loads(exports.dataset_document(a, c, d, 2).first()["document"])
    assert doc["dataset"]["asset_key"] == "air" and [x["name"] for x in doc["columns"]] == ["city_id", "time", "pm2_5"] and doc["row_count"] == len(doc["rows"]) == 2
    assert json.loads(exports.catalog_document(a, c).first()["document"])["columns"][2]["unit"] == "µg"


def test_answers_and_collection(spark, tmp_path):
    (tmp_path / "air_quality").mkdir()
    body = {"hourly": {"time": ["2026-01-10T11:00", "2026-01-10T13:00"], "pm2_5": [1.0]}}
    (tmp_path / "air_quality/a.json").write_text(json.dumps(body))
    (tmp_path / "air_quality/b.json").write_text('{"error": true, "reason": "too many"}')
    (tmp_path / "air_quality/c.json").write_text('{"hourly": {"x": []}}')
    got = endpoints.answers(spark, str(tmp_path), "air_quality", ["a", "b", "c", "d"])
    cities = spark.createDataFrame([(c, NOW) for c in "abcd"], "city_id string, local_now timestamp_ntz")
    rows, outcomes = jobs.collected(got, cities, {"pm2_5": "double"}, "air_quality")
    assert sorted((r["time"], r["pm2_5"], r["is_forecast"]) for r in rows.collect()) == [("2026-01-10T11:00", 1.0, 0), ("2026-01-10T13:00", None, 1)]
    assert {r["city_id"]: (r["status"], r["rows"], (r["error"] or "")[:8]) for r in outcomes.collect()} == {"a": ("success", 2, ""), "b": ("failed", 0, "too many"), "c": ("failed", 0, "the answ"), "d": ("failed", 0, "FileNotF")}
    o = jobs.outcome(outcomes).first()
    assert (o["cities"], o["failed"], o["rows"], o["status"]) == (4, 3, 2, "partial")
    assert endpoints.requests(spark.createDataFrame([("a", "A", 1.0, 2.0, None)], "city_id string, name string, latitude double, longitude double, timezone string"), "archive", "2026-01-10", start="2026-01-08", end="2026-01-09").count() == 0
    geo = spark.createDataFrame([("a", '{"results": [{"name": "far", "latitude": 50.0, "longitude": 2.0}, {"name": "near", "latitude": 1.1, "longitude": 2.0}]}'), ("b", "{}")], "city_id string, body string")
    where = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0)], "city_id string, latitude double, longitude double")
    assert {r["city_id"]: (r["name"], r["far"]) for r in jobs.located(where, geo).collect()} == {"a": ("near", False), "b": (None, True)}


def test_pipeline_of_jobs(spark):
    done = []

    def fails():
        return spark.sql("SELECT nothing").count()

    js = [jobs.Job("daily", "derive", lambda: done.append("daily") or 1, ("hourly",)), jobs.Job("hourly", "derive", lambda: done.append("hourly") or 2, ("air",)), jobs.Job("air", "collect", fails), jobs.Job("places", "reference", lambda: done.append("places") or 3)]
    got = {r["job"]: (r["status"], r["rows_written"]) for r in jobs.run_pipeline(spark, js, "r", NOW).collect()}
    assert got == {"air": ("failed", 0), "places": ("success", 3), "hourly": ("skipped", 0), "daily": ("skipped", 0)} and done == ["places"]
    assert [j.name for j in jobs.ordered(js, "derive")] == ["hourly", "daily"] and jobs.ordered(js, "status_only") == []
    with pytest.raises(ValueError):
        jobs.ordered([jobs.Job("a", "derive", int, ("b",)), jobs.Job("b", "derive", int, ("a",))])
    with pytest.raises(ValueError):
        jobs.ordered(js, "everything")


def test_checks_are_isolated(spark):
    d = spark.createDataFrame([(1,), (None,)], "a int")
    ok = lambda: quality.evaluate(d, [quality.Check("n", "completeness", quality.null_rate(["a"]))])
    got = {r["asset"]: (r["status"], r["score"]) for r in quality.isolated(spark, {"x": lambda: d.select("nope"), "y": ok}).collect()}
    assert got == {"x": ("error", None), "y": ("failed", 50.0)}
    with pytest.raises(AnalysisException):
        d.select("nope").collect()
    assert quality.daily_extremes(["a"]) is None and quality.index_matches_level(["aqi_level"]) is None
    s = spark.createDataFrame([("a", NOW + dt.timedelta(hours=5)), ("b", None)], "c string, time timestamp_ntz")
    assert {r["c"]: r["s"] for r in s.groupBy("c").agg(quality.freshness("time", F.lit(NOW), 60).alias("s")).collect()} == {"a": 100.0, "b": 0.0}


def test_clusters_against_plain_numbers(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (8, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    names = [f"e{i:02d}" for i in range(24)]
    f = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x, strict=True)], "entity string, v array<double>")
    c = similar.cluster(f, 3, restarts=3)
    label = {r["entity"]: r["cluster"] for r in c.collect()}
    assert [label[n] for n in names] == [0] * 8 + [1] * 8 + [2] * 8
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    own = np.array([label[n] for n in names])
    scores = []
    for i in range(24):
        a = dist[i][own == own[i]].sum() / 7
        b = min(dist[i][own == k].mean() for k in range(3) if k != own[i])
        scores.append((b - a) / max(a, b))
    s = similar.silhouette(f, c).first()
    assert abs(s["silhouette"] - np.mean(scores)) < 1e-9 and s["n"] == 24
    best = {r["k"]: r["best"] for r in similar.choose_k(f, 2, 4, 2).collect()}
    assert best == {2: False, 3: True, 4: False}
    r = similar.cluster_report(f, c, ["heat", "rain"]).collect()
    sim = 1 - dist / dist.max()
    assert [x["size"] for x in r] == [8, 8, 8] and {x["label"] for x in r} >= {"heat偏高型", "rain偏高型"}
    first = {m["entity"]: m["affinity"] for m in r[0]["members"]}
    assert abs(first["e00"] - np.mean([sim[0][j] for j in range(1, 8)])) < 1e-4
    alone = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [9.0])], "entity string, v array<double>")
    lone = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "entity string, cluster int")
    assert similar.silhouette(alone, lone).first()["n"] == 2


def test_read_model_without_data(spark):
    h = spark.createDataFrame([], "city_id string, time timestamp_ntz, is_forecast int, weather_code int, european_aqi double, temperature_2m double, pm2_5 double, pm10 double")
    c = spark.createDataFrame([("a", "A", "Mars/Base", True)], "city_id string, name string, timezone string, active boolean")
    assert read_model.current(h, c).count() == read_model.alert_list(read_model.current(h, c)).count() == read_model.hourly_series(h, "a", NOW).count() == 0
    assert read_model.city_index(c, F.lit(NOW)).first()["local_now"] == NOW
    one = spark.createDataFrame([("a", NOW, 0, 61, 120.0, 36.0, 1.0, 2.0), ("a", NOW + dt.timedelta(hours=1), 1, 0, 1.0, 1.0, 1.0, 2.0), ("q", NOW, None, None, None, None, None, None)], h.schema)
    got = {r["city_id"]: r for r in read_model.current(one, c).collect()}
    assert (got["a"]["time"], got["a"]["weather_label"], got["a"]["aqi_level"], got["a"]["data_kind"], [x["key"] for x in got["a"]["alerts"]]) == (NOW, "小雨", "严重污染", "实况", ["air.severe_pollution", "weather.heat_wave"])
    assert (got["q"]["city_name"], got["q"]["weather_label"], got["q"]["aqi_color"], got["q"]["alerts"]) == ("q", "未知", "#94a3b8", [])


def test_thinned_and_outliers_of_odd_groups(spark):
    d = spark.createDataFrame([("a", i, float(i % 7)) for i in range(100)] + [("b", 5, 1.0)] * 3, "g string, i int, v double")
    got = stats.thinned(d, ["g"], ["i"], 10)
    assert sorted(r["i"] for r in got.where("g = 'a'").collect()) == list(range(0, 100, 10)) and got.where("g = 'b'").count() == 3
    b = stats.boxplot(spark.createDataFrame([("a", float(v)) for v in [*range(1, 10), 100, 90, 80]], "g string, v double"), "v", ["g"], most=2).first()
    assert b["outliers"] == [80.0, 90.0] and b["n_outliers"] == 3
    assert stats.interpretation(F.lit(None).cast("double"), F.lit(0.1), "x", "y") is not None


def test_insights_by_name(spark):
    rows = [(c, dt.datetime(2026, 1, 1) + dt.timedelta(hours=h), float(v), float(v) / 2, 10.0 + h % 24, 5.0 + h % 7) for c, base in (("a", 20), ("b", 60), ("c", 110), ("d", 200)) for h in range(96) for v in [base + h % 24]]
    hourly = spark.createDataFrame(rows, "city_id string, time timestamp_ntz, pm2_5 double, pm10 double, temperature_2m double, wind_speed_10m double").withColumns({"european_aqi": F.col("pm2_5"), "china_aqi": F.col("pm2_5")}).cache()
    daily = hourly.groupBy("city_id", F.to_date("time").alias("date")).agg(F.avg("china_aqi").alias("china_aqi"), F.avg("european_aqi").alias("aqi_avg"), F.count_if(F.col("china_aqi") > 100).alias("exceed_hours"), F.count("*").alias("obs_hours"))
    cities = spark.createDataFrame([(c, c != "d") for c in "abcd"], "city_id string, active boolean")
    run = lambda key, **p: insights.run(key, {"hourly": hourly, "daily": daily}, cities, dt.datetime(2026, 1, 5), **p)
    assert {r["entity"] for r in run("distribution").collect()} == {"a", "b", "c", None}
    assert run("correlation").first()["strength"] == "极强正相关"
    assert run("hourly-profile").where("entity = 'a'").first()["peak_hour"] == 23
    assert run("weekly-profile").count() == run("monthly-trend").count() == 3
    assert run("outliers").count() == run("outliers", method="iqr", threshold=1.5).count() == 3
    assert {r["city_id"] for r in run("episodes").collect()} == {"c"} and run("episodes", limit=1).count() == 1
    assert run("relationship").count() == 4
    c = {r["entity"]: r for r in run("compliance", ceiling=75.0).collect()}
    assert (c["a"]["target_met"], c["c"]["target_met"], c[None]["days"], c["c"]["exceed_hour_percent"]) == (True, False, 12, 100.0)
    assert {r["trend"] for r in run("comparison", days=7).collect()} == {"数据不足"}
    assert sum(r["size"] for r in run("clustering", k=2, restarts=2).collect()) == 3
    for bad in ({"key": "nope"}, {"key": "outliers", "threshold": 11}, {"key": "clustering", "k": 9}, {"key": "episodes", "gap": -1}):
        with pytest.raises(ValueError):
            run(**bad)
    with pytest.raises(ValueError):
        similar._few(spark.range(similar.MOST + 1))
    assert reading.scalar(reading.sql(spark, "SELECT :x AS v", x=3)) == 3 and reading.scalar(spark.range(0)) is None


def test_live_coverage_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("a", "2026-01-01T01:00:00"), ("a", "2026-01-01T05:00:00"), ("a", "2026-01-02T01:00:00"), ("b", "2026-01-01T01:00:00")]
    (tmp_path / "in/x.json").write_text("".join(json.dumps({"city_id": c, "time": t}) + "\n" for c, t in rows))
    stream = spark.readStream.schema("city_id string, time timestamp").json(str(tmp_path / "in"))
    q = live_coverage(stream).writeStream.format("memory").queryName("coverage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["city_id"], r["n"]) for r in spark.table("coverage").collect()) == [("a", 1), ("a", 2), ("b", 1)]
