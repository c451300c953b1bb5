"""Operators on small literal frames with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aerolake.functions import standards as S
from aerolake.operators import joins, patterns, stats
from aerolake.plans import derive, quality, summary
from aerolake.sources import lake
from aerolake.sources.lake import Asset, partitions, rows_of, scan, upsert
from aerolake.streaming.ingest import ingest


def column(spark, values, expr, kind="double"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", expr.alias("x")).orderBy("i").select("x").collect()]


def test_iaqi_at_breakpoints(spark):
    assert column(spark, [0.0, 35.0, 75.0, 115.0, 150.0, 180.0, 250.0, 350.0, 500.0, 501.0, -1.0, None], S.iaqi(F.col("v"), "pm2_5")) == [0, 50, 100, 150, 200, 230, 300, 400, 500, 500, None, None]
    assert column(spark, [265.0, 500.0, 800.0], S.iaqi(F.col("v"), "ozone")) == [200, 243.93, 500]


def test_levels_at_band_edges(spark):
    assert column(spark, [20.0, 20.01, 40.0, 40.01, 100.0, 100.01, None, float("nan")], S.aqi_level_index(F.col("v"))) == [1, 2, 2, 3, 5, 6, None, None]


def test_primary_pollutant_ties_and_low_loads(spark):
    d = spark.createDataFrame([(75.0, 150.0), (10.0, 10.0), (None, None)], "pm2_5 double, pm10 double")
    got = d.select(S.primary_pollutant({c: F.col(c) for c in d.columns}).alias("p"), S.china_aqi({c: F.col(c) for c in d.columns}).alias("c")).collect()
    assert [r["p"] for r in got] == ["PM2.5", "无", "无"]
    assert [tuple(r["c"]) for r in got] == [(100.0, "良", "PM2.5"), (14.29, "优", "无"), (None, "", "无")]


def test_alerts_keep_the_gravest_of_a_metric(spark):
    d = spark.createDataFrame([(124.0, 33.0), (10.0, None)], "european_aqi double, temperature_2m double")
    got = d.select(S.alerts({c: F.col(c) for c in d.columns}).alias("a")).collect()
    assert [[x["key"] for x in r["a"]] for r in got] == [["air.severe_pollution", "weather.heat_warning"], []]


def test_comfort_defaults(spark):
    got = column(spark, [23.0, None], S.comfort_index(F.col("v"), F.lit(None).cast("double"), F.lit(None).cast("double")))
    assert got[0] is not None and 90 < got[0] <= 100 and got[1] is None


def series(spark, values, start="2024-01-01"):
    t = dt.datetime.fromisoformat(start)
    return spark.createDataFrame([("e", t + dt.timedelta(hours=i), v) for i, v in enumerate(values)], "entity string, time timestamp_ntz, value double")


def test_episodes_bridge_gaps(spark):
    over = [1.0 if x == "1" else 0.0 for x in "1000100001"]
    got = patterns.episodes(series(spark, over), 0.5, gap=3, shortest=2).collect()
    assert [(r["duration"], r["n_over"]) for r in got] == [(5, 2)]


def test_latest_puts_nulls_last(spark):
    d = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", None, 3)], "c string, f int, t int")
    assert patterns.latest(d, [F.col("f").asc_nulls_last(), F.col("t").desc_nulls_last()], ["c"]).first()["t"] == 1


def test_describe_and_constant_series(spark):
    d = spark.createDataFrame([("a", float(v)) for v in [*range(1, 10), 100]] + [("b", 2.0)] * 3, "g string, v double")
    r = {x["g"]: x for x in stats.describe(d, "v", ["g"]).collect()}
    assert [round(r["a"][k], 4) for k in ("p5", "p25", "p50", "p75", "p95", "iqr")] == [1.45, 3.25, 5.5, 7.75, 59.05, 4.5]
    assert r["b"]["std"] == 0
    assert {x["z"] for x in stats.z_scores(d.where("g = 'b'"), "v", ["g"]).collect()} == {0.0}
    h = stats.histogram(d.where("g = 'b'"), "v", ["g"], 4).orderBy("bin").collect()
    assert (h[0]["left_edge"], h[-1]["right_edge"], sum(x["n"] for x in h)) == (1.5, 2.5, 3)


def test_pair_of_constant_and_ties(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", 2.0, 4.0), ("a", 3.0, 5.0), ("a", 3.0, 6.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0)], "g string, x double, y double")
    r = {x["g"]: x for x in stats.pair(d, "x", "y", ["g"]).collect()}
    assert 0.8 < r["a"]["spearman"] < 1 and r["b"]["pearson"] is None and r["b"]["slope"] is None


def test_fuse_prefers_the_first(spark):
    a = spark.createDataFrame([(1, 10.0, None), (2, None, 5.0)], "k int, v double, w double")
    b = spark.createDataFrame([(2, 20.0), (3, 30.0)], "k int, v double")
    assert sorted((r["k"], r["v"]) for r in joins.fuse(a, b, ["k"]).collect()) == [(1, 10.0), (2, 20.0), (3, 30.0)]


def test_hourly_uses_what_there_is(spark):
    cols = "pm2_5 pm10 ozone nitrogen_dioxide sulphur_dioxide carbon_monoxide european_aqi temperature_2m relative_humidity_2m wind_speed_10m precipitation".split()
    d = spark.createDataFrame([("c", dt.datetime(2026, 1, 1, h), *[18.0, 28.8, 60.0, 25.0, 8.0, 300.0, 25.0, 20.0, 50.0, 6.0, 0.0]) for h in range(3)], "city_id string, time timestamp_ntz, " + ", ".join(f"{c} double" for c in cols))
    assert derive.hourly(d).orderBy("time").first()["china_aqi"] == 31.25  # nitrogen dioxide alone


def test_all_null_sums_are_zero(spark):
    cols = "pm2_5 pm10 ozone nitrogen_dioxide sulphur_dioxide carbon_monoxide european_aqi temperature_2m relative_humidity_2m wind_speed_10m precipitation".split()
    d = spark.createDataFrame([("c", dt.datetime(2026, 1, 1), *[None] * len(cols))], "city_id string, time timestamp_ntz, " + ", ".join(f"{c} double" for c in cols))
    r = derive.daily(derive.hourly(d)).first()
    assert (r["precipitation_sum"], r["stagnant_hours"], r["exceed_hours"], r["temp_avg"]) == (0, 0, 0, None)


def test_quality_of_an_empty_table(spark):
    d = spark.createDataFrame([], "a int, b int")
    got = quality.evaluate(d, [quality.Check("n", "completeness", quality.null_rate(["a"])), quality.Check("k", "uniqueness", quality.unique(["a"]))]).collect()
    assert {r["status"] for r in got} == {"skipped"}


ASSET = Asset("weather", {"city_id": "string", "time": "timestamp", "value": "double", "n": "integer"}, ("city_id", "time"))


def test_upsert_twice_and_over_a_month(spark, tmp_path):
    d = spark.createDataFrame([("a", f"2026-01-31T{22 + h}:00", "1.5", "2.5", "x") for h in (0, 1)] + [("a", f"2026-02-01T0{h}:00", "not-a-number", "3.5", "x") for h in (0, 1)], "city_id string, time string, value string, n string, extra string")
    for _ in range(2):
        r = upsert(d, str(tmp_path), ASSET).first()
    assert (r["rows_received"], r["missing_columns"], r["extra_columns"]) == (4, [], ["extra"])
    assert (r["rows_merged"], r["rows_written"], r["duplicates_removed"], r["partitions_written"]) == (4, 4, 4, 2) and r["bytes_written"] > 0
    assert (r["earliest_data_time"], r["latest_data_time"]) == (dt.datetime(2026, 1, 31, 22), dt.datetime(2026, 2, 1, 1)) and len(r["schema_hash"]) == 64
    got = scan(spark, str(tmp_path), ASSET).orderBy("time").collect()
    assert [(x["value"], x["n"]) for x in got] == [(1.5, 2), (1.5, 2), (None, 4), (None, 4)]
    assert sorted(p.name for p in (tmp_path / "weather/city=a/year=2026").iterdir()) == ["month=01", "month=02"]
    assert scan(spark, str(tmp_path), ASSET, ["a"], "2026-02-01T00:00", "2026-02-28").count() == 2
    upsert(spark.createDataFrame([("a", "2026-02-01T00:00", 9.0)], "city_id string, time string, value double"), str(tmp_path), ASSET)
    assert scan(spark, str(tmp_path), ASSET).where("value = 9.0").count() == 1 and scan(spark, str(tmp_path), ASSET).count() == 4
    assert partitions(spark, str(tmp_path), ASSET).count() == 2


CITIES = ["Coeur d'Alene", "a/b", "c:d e", "x=y%20z", None]


def test_upsert_of_odd_partition_values(spark, tmp_path):
    rows = [(c, f"2026-01-0{k + 1}T00:00", float(k)) for c in CITIES for k in range(2)]
    make = lambda rows: spark.createDataFrame(rows, "city_id string, time string, value double")
    for n in range(2):
        r = upsert(make(rows), str(tmp_path), ASSET).first()
        assert (r["partitions_written"], r["rows_written"], r["duplicates_removed"]) == (5, 10, 10 * n)
    upsert(make([("a/b", "2026-01-01T00:00", 7.0), (None, "2026-02-01T00:00", 8.0)]), str(tmp_path), ASSET)
    got = scan(spark, str(tmp_path), ASSET)
    assert got.count() == 11 and got.where("value = 7.0").first()["city_id"] == "a/b"
    assert {r["city_id"] for r in got.collect()} == set(CITIES)
    assert lake.read_partition(spark, str(tmp_path), ASSET, "a/b", 2026, 1).count() == 2 and lake.has_data(spark, str(tmp_path), ASSET, "c:d e") and not lake.has_data(spark, str(tmp_path), ASSET, "q")
    s = lake.dataset_stats(spark, str(tmp_path), ASSET).first()
    assert (s["row_count"], s["file_count"], s["partition_count"]) == (11, 6, 6)


def test_upsert_without_times(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "city_id string, time string, value double")
    r = upsert(make([("a", "2026-01-01T00:00", 1.0), ("a", "never", 2.0)]), str(tmp_path), ASSET).first()
    assert (r["rows_received"], r["rows_without_time"], r["rows_written"]) == (2, 1, 1)
    with pytest.raises(ValueError):
        upsert(make([("a", "never", 2.0)]), str(tmp_path), ASSET)
    assert upsert(make([]), str(tmp_path), ASSET).first()["rows_written"] == 0
    assert scan(spark, str(tmp_path), ASSET).count() == 1 and not list((tmp_path / "_work").glob("*"))


def test_upsert_puts_everything_back_if_a_swap_fails(spark, tmp_path, monkeypatch):
    make = lambda v: spark.createDataFrame([(c, "2026-01-01T00:00", v) for c in "abc"], "city_id string, time string, value double")
    upsert(make(1.0), str(tmp_path), ASSET)
    real, calls = lake._rename, []

    def failing(fs, a, b):
        calls.append(a)
        if len(calls) == 4:
            raise OSError("lost")
        real(fs, a, b)

    monkeypatch.setattr(lake, "_rename", failing)
    with pytest.raises(OSError):
        upsert(make(2.0), str(tmp_path), ASSET)
    assert sorted((r["city_id"], r["value"]) for r in scan(spark, str(tmp_path), ASSET).collect()) == [("a", 1.0), ("b", 1.0), ("c", 1.0)]


def test_upsert_reads_only_touched_partitions(spark, tmp_path):
    upsert(spark.createDataFrame([(c, f"2026-0{m}-01T00:00", 1.0) for c in "ab" for m in (1, 2)], "city_id string, time string, value double"), str(tmp_path), ASSET)
    d = lake._whole(spark, str(tmp_path), ASSET)
    for c, v in (("city", {"a"}), ("year", {"2026"}), ("month", {"01", None})):
        d = d.where(lake._among(c, v))
    filters = d._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert all(f"{c}#" in filters for c in ("city", "year", "month"))
    assert len(d.select("_metadata.file_path").distinct().collect()) == 1


def test_scan_of_nothing(spark, tmp_path):
    assert scan(spark, str(tmp_path), ASSET).columns == list(ASSET.columns)


def test_columnar_json_pads_short_arrays(spark):
    d = spark.createDataFrame([("a", '{"hourly": {"time": ["t1", "t2"], "v": [1.0]}}')], "city_id string, body string")
    assert [(r["time"], r["v"]) for r in rows_of(d, {"v": "double"}).collect()] == [("t1", 1.0), ("t2", None)]


def test_stream_into_the_lake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"city_id": "a", "time": "2026-01-01T00:00:00", "value": 1.0, "n": 1}\n')
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "lake"), ASSET, str(tmp_path / "check")).awaitTermination()
    assert scan(spark, str(tmp_path / "lake"), ASSET).count() == 1


@pytest.mark.parametrize("km", [100.0, 300.0])
def test_nearest(spark, km):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 60.0, 0.0)], "id int, lat double, lon double")
    c = spark.createDataFrame([(7, 0.5, 0.0), (8, 0.4, 0.1)], "cand_id int, lat double, lon double")
    assert sorted((r["id"], r["cand_id"], r["far"]) for r in joins.nearest(p, c, km).collect()) == [(1, 8, False), (2, 7, True)]  # the nearest one, however far


def test_statuses(spark):
    jobs = spark.createDataFrame([(0, 0, 0), (3, 0, 5), (3, 0, 0), (3, 1, 5), (3, 3, 0)], "n int, bad int, rows int")
    got = [tuple(r) for r in jobs.select(summary.job_status(F.col("n"), F.col("bad")), summary.job_status(F.col("n"), F.col("bad"), F.col("rows"))).collect()]
    assert got == [("skipped", "skipped"), ("success", "success"), ("success", "skipped"), ("partial", "partial"), ("failed", "failed")]
    for statuses, want in [([], "skipped"), (["failed"] * 2, "failed"), (["failed", "skipped"], "partial"), (["partial"], "partial"), (["skipped"] * 2, "skipped"), (["success", "skipped"], "success")]:
        assert spark.createDataFrame([(s,) for s in statuses], "status string").agg(summary.pipeline_status()).first()[0] == want


def test_summaries_of_nulls_and_nothing(spark):
    r = spark.createDataFrame([(None, "success", 3, 2), ("a", None, 4, None), ("a", "failed", 1, 9)], "job string, status string, started_at int, n int")
    got = {(x["job"], x["overall"]): (x["total"], x["success"], x["success_rate"], x["total_n"]) for x in summary.runs(r, F.lit(2), ["n"]).collect()}
    assert got == {(None, False): (1, 1, 100.0, 2), ("a", False): (1, 0, 0.0, 0), (None, True): (2, 1, 50.0, 2)}
    assert summary.facets(r.limit(0), ["job"]).count() == 0
    assert {(x["value"], x["n"]) for x in summary.facets(r, ["job"]).collect()} == {(None, 1), ("a", 2)}


def test_partition_sizes(spark, tmp_path):
    d = spark.createDataFrame([("a", "01", 1), ("a", "02", 2), ("b", "01", 3)], "city string, month string, v int")
    d.write.partitionBy("city", "month").parquet(str(tmp_path / "lake"))
    got = summary.partition_sizes(spark.read.parquet(str(tmp_path / "lake")), "city", ["city", "month"]).orderBy("city").collect()
    size = lambda c: sum(f.stat().st_size for f in (tmp_path / f"lake/city={c}").rglob("*.parquet"))
    assert [(r["city"], r["partitions"], r["bytes"]) for r in got] == [("a", 2, size("a")), ("b", 1, size("b"))]
