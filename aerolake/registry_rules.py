"""Queries of checks that are compiled from configuration, with DuckDB counterparts that state the rules again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake import rounds
from aerolake.operators import similar, stats
from aerolake.plans import checks, jobs
from aerolake.registry import _FEATURES, features, hours, query, rounded, table
from aerolake.registry_views import _EVENTS, _scratch
from aerolake.sources import lake

#: Three tables and the rules for them, as a data owner writes them.
CONFIGURATION = """
assets:
  - key: stream.events
    entity: event_type
    time: ts
    primary_key: [event_type, user_id, day]
    columns:
      - {name: v, type: double, nullable: false, range: [0.5, 120]}
      - {name: user_id, type: integer, nullable: false, range: [3, 148]}
      - {name: k, type: integer, nullable: false, enum: [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]}
      - {name: kind, type: string, enum: [click, view, purchase, signup]}
      - {name: ts, type: timestamp}
      - {name: gone, type: double, range: [0, 1]}
  - key: served.hours
    entity: entity
    time: time
    sla_freshness_minutes: 45
    primary_key: [entity, time]
    columns:
      - {name: value, type: double, range: [10, 60]}
  - key: sales.orders
    entity: o_orderpriority
    time: o_orderdate
    granularity: daily
    primary_key: [o_orderpriority, o_orderdate]
    columns:
      - {name: o_totalprice, type: double, nullable: false, range: [2000, 490000]}
      - {name: o_orderstatus, type: string, enum: [O, F]}
      - {name: o_orderkey, type: string}
rules:
  defaults: {evaluation_window_hours: 240, outlier_warn: 0.01, outlier_fail: 0.60, null_rate_warn: 0.01, null_rate_fail: 0.10, duplicate_fail: 0.5}
  checks:
    - {key: completeness.null_rate, severity: critical}
    - key: completeness.time_coverage
      severity: critical
      applies_to: ["served.*"]
      params:
        anchor_hours_by_asset: {served.hours: -24}
        span_hours_by_asset: {served.hours: 96}
    - {key: timeliness.freshness, severity: critical, applies_to: [served.hours]}
    - {key: validity.range}
    - {key: validity.enum, severity: minor}
    - {key: validity.type_conformance}
    - {key: uniqueness.primary_key, severity: critical}
    - {key: consistency.rule, name: small_users, applies_to: [stream.events], params: {columns: [v, user_id], holds: v <= user_id * 5}}
    - {key: consistency.pm25_le_pm10}
"""


def _assets() -> dict[str, checks.Asset]:
    return {a["key"]: checks.Asset.of(a) for a in checks.load(CONFIGURATION)["assets"]}


def _events(spark, sf_dir) -> DataFrame:
    """Events with some values missing and a field of their properties."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("day"), "user_id", "event_type", F.col("event_type").alias("kind"), F.when(F.col("value") <= 150, F.col("value")).alias("v"), F.when(k < 90, k).alias("k"))


def _clocks(d: DataFrame, entity: str, time: str) -> DataFrame:
    """A clock for each entity, behind its last row by hours that depend on the name; one has none."""
    last = d.where(F.col(entity) != "signup").groupBy(F.col(entity).alias("entity")).agg(F.max(time).alias("t"))
    return last.select("entity", (F.date_trunc("hour", "t").cast("timestamp_ntz") + F.make_dt_interval(hours=F.length("entity") - 5)).alias("local_now"))


_JUDGED = """
e AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type AS entity, CASE WHEN value <= 150 THEN value END AS v,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 90 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events),
ec AS (SELECT entity, date_trunc('hour', max(ts)) + to_hours(length(entity) - 5) AS now FROM e WHERE entity <> 'signup' GROUP BY 1),
ew AS (SELECT e.* FROM e LEFT JOIN ec USING (entity) WHERE now IS NULL OR ts BETWEEN now - INTERVAL 240 HOUR AND now + INTERVAL 1 HOUR),
h AS (SELECT event_type AS entity, date_trunc('hour', ts) AS time, avg(value) AS value FROM events GROUP BY 1, 2),
hc AS (SELECT entity, max(time) + to_hours(length(entity) - 5) AS now FROM h WHERE entity <> 'signup' GROUP BY 1),
hw AS (SELECT h.* FROM h LEFT JOIN hc USING (entity) WHERE now IS NULL OR time BETWEEN now - INTERVAL 240 HOUR AND now + INTERVAL 1 HOUR),
o AS (SELECT *, o_orderpriority AS entity FROM orders),
oc AS (SELECT entity, date_trunc('day', date_trunc('hour', max(o_orderdate)) + to_hours(length(entity) - 5)) AS now FROM o GROUP BY 1),
ow AS (SELECT o.* FROM o LEFT JOIN oc USING (entity) WHERE now IS NULL OR o_orderdate BETWEEN now - INTERVAL 240 HOUR AND now + INTERVAL 1 HOUR),
j AS (
SELECT 'stream.events' AS asset, 'completeness.null_rate' AS "check", 'v' AS part, entity, ts AS time, 'null' AS value, v IS NULL AS bad FROM ew
UNION ALL SELECT 'stream.events', 'completeness.null_rate', 'user_id', entity, ts, 'null', user_id IS NULL FROM ew
UNION ALL SELECT 'stream.events', 'completeness.null_rate', 'k', entity, ts, 'null', k IS NULL FROM ew
UNION ALL SELECT 'sales.orders', 'completeness.null_rate', 'o_totalprice', entity, o_orderdate, 'null', o_totalprice IS NULL FROM ow
UNION ALL SELECT 'stream.events', 'validity.range', 'v', entity, ts, CAST(CAST(v AS DECIMAL(18, 3)) AS VARCHAR), v < 0.5 OR v > 120 FROM ew
UNION ALL SELECT 'stream.events', 'validity.range', 'user_id', entity, ts, CAST(CAST(user_id AS DECIMAL(18, 3)) AS VARCHAR), user_id < 3 OR user_id > 148 FROM ew
UNION ALL SELECT 'served.hours', 'validity.range', 'value', entity, time, CAST(CAST(value AS DECIMAL(18, 3)) AS VARCHAR), value < 10 OR value > 60 FROM hw
UNION ALL SELECT 'sales.orders', 'validity.range', 'o_totalprice', entity, o_orderdate, CAST(CAST(o_totalprice AS DECIMAL(18, 3)) AS VARCHAR), o_totalprice < 2000 OR o_totalprice > 490000 FROM ow
UNION ALL SELECT 'stream.events', 'validity.enum', 'k', entity, ts, CAST(CAST(k AS DECIMAL(18, 3)) AS VARCHAR), k NOT BETWEEN 1 AND 12 FROM ew
UNION ALL SELECT 'stream.events', 'validity.enum', 'kind', entity, ts, entity, entity NOT IN ('click', 'view', 'purchase', 'signup') FROM ew
UNION ALL SELECT 'sales.orders', 'validity.enum', 'o_orderstatus', entity, o_orderdate, o_orderstatus, o_orderstatus NOT IN ('O', 'F') FROM ow
UNION ALL SELECT 'stream.events', 'small_users', '', entity, ts, CAST(CAST(v AS DECIMAL(18, 3)) AS VARCHAR) || ', ' || CAST(CAST(user_id AS DECIMAL(18, 3)) AS VARCHAR), v > user_id * 5 FROM ew),
p AS (SELECT asset, "check", part, count(bad) AS checked, count(*) FILTER (bad) AS failed FROM j GROUP BY ALL),
s AS (SELECT asset, "check", string_agg(part || '|' || entity || '|' || strftime(time, '%Y-%m-%d %H:%M:%S') || '|' || value, '; ' ORDER BY part, entity, strftime(time, '%Y-%m-%d %H:%M:%S'), value) AS samples
    FROM (SELECT * FROM j WHERE bad QUALIFY row_number() OVER (PARTITION BY asset, "check", part ORDER BY entity, strftime(time, '%Y-%m-%d %H:%M:%S'), value) <= CASE "check" WHEN 'validity.range' THEN 3 ELSE 5 END) GROUP BY ALL),
w AS (SELECT *, CASE "check" WHEN 'completeness.null_rate' THEN 0.01 WHEN 'small_users' THEN 0.02 ELSE 0.01 END AS warn, CASE "check" WHEN 'completeness.null_rate' THEN 0.10 WHEN 'small_users' THEN 0.10 ELSE 0.60 END AS fail FROM p),
c AS (SELECT asset, "check", sum(checked) AS checked, sum(failed) AS failed, any_value(warn) AS warn, any_value(fail) AS fail,
    avg(greatest(0, least(100, ROUND((fail - failed / checked) / (fail - warn) * 100, 2)))) AS each FROM w GROUP BY ALL),
u AS (SELECT 'stream.events' AS asset, entity, day, user_id, count(*) AS n FROM e GROUP BY ALL),
us AS (SELECT 'stream.events' AS asset, sum(n) AS checked, sum(n - 1) AS failed, NULL AS samples FROM u
    UNION ALL SELECT 'served.hours', count(*), 0, NULL FROM hw
    UNION ALL SELECT 'sales.orders', sum(n), sum(n - 1), NULL FROM (SELECT entity, o_orderdate, count(*) AS n FROM ow GROUP BY ALL)),
d AS (SELECT 'stream.events' AS asset, entity, '' AS time, user_id || ', ' || day || ', ' || n || ' rows' AS value FROM u WHERE n > 1
    UNION ALL SELECT 'sales.orders', entity, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), n || ' rows' FROM (SELECT entity, o_orderdate, count(*) AS n FROM ow GROUP BY ALL) WHERE n > 1),
ds AS (SELECT asset, string_agg('|' || entity || '|' || time || '|' || value, '; ' ORDER BY entity, time, value) AS samples FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY asset ORDER BY entity, time, value) <= 5) GROUP BY 1),
cv AS (SELECT entity, least(96, count(DISTINCT time) FILTER (now IS NULL OR time BETWEEN now - INTERVAL 120 HOUR AND now - INTERVAL 23 HOUR)) AS n FROM h LEFT JOIN hc USING (entity) GROUP BY 1),
fr AS (SELECT entity, date_diff('second', max(time) FILTER (time <= now + INTERVAL 1 HOUR), any_value(now)) / 60.0 AS late, max(time) FILTER (time <= now + INTERVAL 1 HOUR) AS last FROM h JOIN hc USING (entity) GROUP BY 1),
fs AS (SELECT *, CASE WHEN late IS NULL OR late <= 45 THEN 100.0 ELSE greatest(0, 100 * (1 - (late - 45) / 90)) END AS score FROM fr)"""
_STATUS = "CASE WHEN score IS NULL THEN 'skipped' WHEN score >= 90 THEN 'passed' WHEN score >= 70 THEN 'warning' ELSE 'failed' END"


@query(f"""WITH {_JUDGED},
r AS (SELECT asset, "check", ROUND(CASE WHEN "check" = 'completeness.null_rate' THEN each ELSE greatest(0, least(100, ROUND((fail - failed / checked) / (fail - warn) * 100, 2))) END + 1e-9, 2) AS score, checked, failed, coalesce(samples, '') AS samples FROM c LEFT JOIN s USING (asset, "check")
UNION ALL SELECT us.asset, 'uniqueness.primary_key', ROUND(greatest(0, least(100, (0.5 - failed / checked) / 0.499 * 100)) + 1e-9, 2), checked, failed, coalesce(ds.samples, '') FROM us LEFT JOIN ds USING (asset)
UNION ALL SELECT 'served.hours', 'completeness.time_coverage', ROUND(avg(100.0 * n / 96) + 1e-9, 2), 96 * count(*), sum(96 - n), '' FROM cv
UNION ALL SELECT 'served.hours', 'timeliness.freshness', ROUND(avg(score) + 1e-9, 2), count(*), count(*) FILTER (score < 100), coalesce(string_agg('|' || entity || '|' || strftime(last, '%Y-%m-%d %H:%M:%S') || '|latest', '; ' ORDER BY entity) FILTER (score < 100), '') FROM fs
UNION ALL SELECT * FROM (VALUES ('stream.events', 'validity.type_conformance', 83.33, 6, 1, '||gone: double, None'), ('served.hours', 'validity.type_conformance', 100, 1, 0, ''), ('sales.orders', 'validity.type_conformance', 66.67, 3, 1, '||o_orderkey: string, bigint'),
    ('served.hours', 'completeness.null_rate', NULL, 0, 0, ''), ('served.hours', 'validity.enum', NULL, 0, 0, ''), ('stream.events', 'consistency.pm25_le_pm10', NULL, 0, 0, ''), ('served.hours', 'consistency.pm25_le_pm10', NULL, 0, 0, ''), ('sales.orders', 'consistency.pm25_le_pm10', NULL, 0, 0, '')) v)
SELECT asset, "check", {_STATUS} AS status, CAST(score AS DOUBLE) AS score, CAST(checked AS BIGINT) AS checked, CAST(failed AS BIGINT) AS failed, samples FROM r""")
def compiled_checks(spark, sf_dir):
    """Three tables against one configuration."""
    conf, assets = checks.load(CONFIGURATION), _assets()
    tables = {"stream.events": _events(spark, sf_dir), "served.hours": hours(spark, sf_dir), "sales.orders": table(spark, sf_dir, "orders")}
    results = []
    for key, d in tables.items():
        a = assets[key]
        results.append(checks.lazy(d, a, conf["rules"], _clocks(d, a.entity, a.time)).withColumn("asset", F.lit(key)))
    return reduce(DataFrame.unionByName, results).select("asset", "check", "status", "score", "checked", "failed", checks.shown(F.col("samples")).alias("samples"))


_FIVE = {
    "checks": [
        {"key": "consistency.rule", "name": "fits", "params": {"columns": ["v"], "holds": "v <= 100"}},
        {"key": "consistency.rule", "name": "unknown_function", "params": {"columns": ["v"], "holds": "no_such_function(v) > 0"}},
        {"key": "validity.range"},
        {"key": "consistency.rule", "name": "fails_when_run", "params": {"columns": ["kind"], "holds": "if(kind = 'error', raise_error('a bad row'), true)"}},
        {"key": "uniqueness.primary_key"},
    ]
}


@query("""WITH e AS (SELECT ts, user_id, event_type AS entity, CASE WHEN value <= 150 THEN value END AS v, CAST(ts AS DATE) AS day FROM events),
u AS (SELECT count(*) AS n FROM e GROUP BY entity, user_id, day),
r AS (SELECT 'fits' AS "check", 0.02 AS warn, 0.10 AS fail, count(v) AS checked, count(*) FILTER (v > 100) AS failed FROM e
UNION ALL SELECT 'validity.range', 0.01, 0.05, count(v) + count(user_id), count(*) FILTER (v < 0.5 OR v > 120) + count(*) FILTER (user_id < 3 OR user_id > 148) FROM e
UNION ALL SELECT 'uniqueness.primary_key', 0.001, 0.01, sum(n), sum(n - 1) FROM u),
s AS (SELECT "check", CAST(ROUND(greatest(0, least(100, ROUND((fail - failed / checked) / (fail - warn) * 100, 2))), 2) AS DOUBLE) AS score, checked, failed FROM r)
SELECT "check", CASE WHEN score >= 90 THEN 'passed' WHEN score >= 70 THEN 'warning' ELSE 'failed' END AS status, score, CAST(checked AS BIGINT) AS checked, CAST(failed AS BIGINT) AS failed FROM s
UNION ALL SELECT * FROM (VALUES ('unknown_function', 'error', NULL, 0, 0), ('fails_when_run', 'error', NULL, 0, 0)) v""")
def isolated_checks(spark, sf_dir):
    """Five checks, one of which can't be analysed and one of which fails when it runs."""
    return checks.run(_events(spark, sf_dir), _assets()["stream.events"], _FIVE).select("check", "status", "score", "checked", "failed")


# --- statistics of changed files ------------------------------------------------------------------------------


@query("""WITH l AS (SELECT event_type || '/' || (user_id % 2) AS city_id, ts, event_id FROM events WHERE event_id % 3 <> 0 OR (event_type = 'click' AND user_id % 2 = 1)), c AS (SELECT DISTINCT city_id FROM l)
SELECT count(*) AS row_count, (SELECT count(*) FROM c) AS city_count, (SELECT count(*) FROM c) AS file_count, date_trunc('second', min(ts)) AS earliest_data_time, date_trunc('second', max(ts)) AS latest_data_time, CAST(1 AS BIGINT) AS files_read FROM l""")
def incremental_stats(spark, sf_dir):
    """Statistics of a lake before and after one of its partitions has changed: the second ones read that file alone."""
    root = _scratch(spark)
    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), F.col("user_id") % 2).alias("city_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.col("event_id").alias("event"), F.col("value"))
    lake.upsert(e.where("event % 3 <> 0"), root, _EVENTS)
    before = rounds.cut(lake.file_stats(spark, root, _EVENTS))
    lake.upsert(e.where("city_id = 'click/1'"), root, _EVENTS)
    after = lake.file_stats(spark, root, _EVENTS, before)
    fresh = after.join(before.select("place", "bytes", "modified"), ["place", "bytes", "modified"], "left_anti").agg(F.count("*").alias("files_read"))
    return lake.summed(after, _EVENTS).crossJoin(fresh).select("row_count", "city_count", "file_count", "earliest_data_time", "latest_data_time", "files_read")  # one row each


# --- jobs from the lake to the lake --------------------------------------------------------------------------

_WEATHER = {"temperature_2m": "double", "relative_humidity_2m": "double", "wind_speed_10m": "double", "precipitation": "double"}
_AIR = {c: "double" for c in ("pm2_5", "pm10", "ozone", "nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide", "european_aqi")}
_KEY = {"city_id": "string", "time": "timestamp"}
_FORECAST = lake.Asset("forecast", _KEY | _WEATHER | {"is_forecast": "integer"}, ("city_id", "time"))
_ARCHIVE = lake.Asset("archive", _KEY | _WEATHER, ("city_id", "time"))
_AIR_QUALITY = lake.Asset("air", _KEY | _AIR, ("city_id", "time"))
_HOURLY = lake.Asset("hourly", _KEY | _WEATHER | _AIR | {"is_forecast": "integer", "china_aqi": "double", "aqi_level": "string", "is_stagnant": "integer", "comfort_index": "double"}, ("city_id", "time"))
_DAILY = lake.Asset("daily", {"city_id": "string", "date": "date", "temp_max": "double", "precipitation_sum": "double", "wind_speed_avg": "double", "pm2_5": "double", "ozone": "double", "aqi_max": "double", "obs_hours": "integer"}, ("city_id", "date"), "date")


@query("""WITH h AS (SELECT event_type AS city_id, date_trunc('hour', ts) AS time, max(value) AS v, count(*) AS n FROM events GROUP BY 1, 2),
f AS (SELECT *, v + 100 AS t, 8.0 AS w FROM h WHERE hour(time) < 8), a AS (SELECT *, v AS t, 4.0 AS w FROM h WHERE hour(time) BETWEEN 6 AND 20), q AS (SELECT * FROM h WHERE hour(time) % 12 <> 0),
u AS (SELECT coalesce(f.city_id, a.city_id, q.city_id) AS city_id, coalesce(f.time, a.time, q.time) AS time, coalesce(f.t, a.t) AS t, coalesce(f.w, a.w) AS w, q.v AS p, CASE WHEN q.v IS NOT NULL THEN q.v * 2 END AS o
    FROM f FULL JOIN a ON f.city_id = a.city_id AND f.time = a.time FULL JOIN q ON coalesce(f.city_id, a.city_id) = q.city_id AND coalesce(f.time, a.time) = q.time),
m AS (SELECT *, CASE WHEN count(o) OVER w8 = 8 THEN avg(o) OVER w8 END AS o8 FROM u WINDOW w8 AS (PARTITION BY city_id ORDER BY time ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT city_id, strftime(time, '%Y-%m-%d') AS date, round(max(t), 4) AS temp_max, round(avg(w), 4) AS wind, round(avg(p), 4) AS pm2_5, round(max(o8), 4) AS ozone, count(*) AS obs_hours FROM m
WHERE city_id IN ('click', 'view') AND time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-16' GROUP BY 1, 2""")
def lake_jobs(spark, sf_dir):
    """Three collected tables in a lake, the hourly and the daily job over a window of it, and what the daily table holds."""
    root = _scratch(spark)
    h = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("city_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg(F.max("value").alias("v"))
    h = rounds.cut(h)
    weather = lambda t, w: {"temperature_2m": t, "relative_humidity_2m": F.lit(50.0), "wind_speed_10m": F.lit(w), "precipitation": F.lit(0.0)}
    lake.upsert(h.where(F.hour("time") < 8).withColumns(weather(F.col("v") + 100, 8.0) | {"is_forecast": F.lit(1)}), root, _FORECAST)
    lake.upsert(h.where(F.hour("time").between(6, 20)).withColumns(weather(F.col("v"), 4.0)), root, _ARCHIVE)
    lake.upsert(h.where(F.hour("time") % 12 != 0).withColumns({c: F.col("v") * (2 if c == "ozone" else 1) for c in _AIR}), root, _AIR_QUALITY)
    window = {"cities": ["click", "view"], "start": "2024-01-10T00:00:00", "end": "2024-01-15T23:00:00"}
    jobs.derive_hourly(spark, root, _FORECAST, _ARCHIVE, _AIR_QUALITY, _HOURLY, window["cities"], "2024-01-09T00:00:00", window["end"])
    jobs.derive_daily(spark, root, _HOURLY, _DAILY, **window)
    d = lake.scan(spark, root, _DAILY)
    return rounded(d.select("city_id", F.col("date").cast("string").alias("date"), "temp_max", F.col("wind_speed_avg").alias("wind"), "pm2_5", "ozone", "obs_hours"))


# --- reports and blocks -----------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), e AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM x),
b AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * 7), 6) AS INT) AS bin, count(*) AS n, avg(y) AS m, median(y) AS h FROM x, e GROUP BY 1), p AS (SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS k FROM x)
SELECT bin, n, round(m, 2) AS mean, round(h, 2) AS median, (SELECT count(*) FROM p, e WHERE k % greatest(1, e.n // 500) = 0) AS points, (SELECT round(sum(x), 2) FROM p, e WHERE k % greatest(1, e.n // 500) = 0) AS sum_x FROM b""")
def relationship_report(spark, sf_dir):
    """The curve of price over quantity and how many points are drawn, from the one report."""
    d = stats.relationship_report(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", 7, 500).where("entity IS NULL")
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"])
    return rounded(d.select(F.size("points").cast("bigint").alias("points"), total.alias("sum_x"), F.inline("curve")).select("bin", "n", "mean", "median", "points", "sum_x"), 2)


_BARS = "x AS (SELECT 'l_quantity' AS metric, l_returnflag AS entity, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_tax', l_returnflag, l_tax FROM lineitem), a AS (SELECT * FROM x UNION ALL SELECT metric, NULL, v FROM x)"


@query(f"""WITH {_BARS}, e AS (SELECT metric, entity, min(v) AS lo, max(v) AS hi FROM a GROUP BY 1, 2), n AS (SELECT a.metric, a.entity, least(floor((v - lo) / ((hi - lo) / 9)), 8) AS bin, count(*) AS n FROM a JOIN e ON a.metric = e.metric AND a.entity IS NOT DISTINCT FROM e.entity GROUP BY 1, 2, 3)
SELECT e.metric, e.entity, CAST(g.bin AS INT) AS bin, coalesce(n.n, 0) AS n FROM e CROSS JOIN range(9) g(bin) LEFT JOIN n ON n.metric = e.metric AND n.entity IS NOT DISTINCT FROM e.entity AND n.bin = g.bin""")
def distribution_histogram(spark, sf_dir):
    d = stats.distribution(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], "l_returnflag", 9)
    return d.select("metric", "entity", F.inline("histogram")).select("metric", "entity", "bin", "n")


@query(f"""WITH {_FEATURES}, c AS (SELECT z.entity, n_regionkey AS c, a, b FROM z JOIN nation ON n_name = entity),
t AS (SELECT x.entity, x.c, y.c AS o, avg(sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2))) AS m FROM c x JOIN c y ON x.entity <> y.entity GROUP BY 1, 2, 3),
s AS (SELECT entity, max(m) FILTER (c = o) AS own, min(m) FILTER (c <> o) AS near FROM t GROUP BY 1) SELECT round(avg((near - own) / greatest(near, own)), 4) AS silhouette, count(*) AS n FROM s WHERE own IS NOT NULL AND near IS NOT NULL""")
def region_silhouette(spark, sf_dir):
    """How well the regions part the nations by their orders."""
    clusters = table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), F.col("n_regionkey").cast("int").alias("cluster"))
    return rounded(similar.silhouette(features(spark, sf_dir), clusters, 8))
