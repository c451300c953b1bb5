"""Queries of the time-series operators on the driver's tables, with DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.functions import standards as S
from aerolake.operators import joins, patterns, report, similar, stats
from aerolake.plans import derive, lineage, quality, summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- roles of the driver's tables --------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, time, value: hourly means of events by type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("entity"), patterns.hour(F.col("ts")).alias("time")).agg(F.avg("value").alias("value"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, date, value: order totals by nation and day. The nation comes from the customer; the
    nations (25 rows of a dimension) are broadcast."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    d = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy(F.col("n_name").alias("entity"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("value"))


HOURS = "h AS (SELECT event_type AS entity, date_trunc('hour', ts) AS time, avg(value) AS value FROM events GROUP BY 1, 2)"
DAYS = "d AS (SELECT n_name AS entity, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


#: Added before rounding on both sides, so that no mean of cents lies on a tie.
OFF_TIES = 3e-7


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, for comparison with another engine that adds up in another order."""
    return df.select(*(F.round(F.col(f.name) + OFF_TIES, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name for f in df.schema.fields))


def _off_ties(sql: str) -> str:
    """OFF_TIES in every lower-case round(x, digits) of a query."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        j, open_ = i + 6, 1
        while open_:
            open_ += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        inner, digits = _off_ties(sql[i + 6 : j - 1]).rsplit(",", 1)
        out += f"{sql[at:i]}round(({inner}) + {OFF_TIES},{digits})"
        at = j
    return out + sql[at:]


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _off_ties(sql)
        return f

    return register


# --- scans and windows ---------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00' AND event_type IN ('click', 'view', 'purchase') ORDER BY ts DESC, event_id LIMIT 500")
def fetch(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("ts").between(F.expr("TIMESTAMP_NTZ '2024-01-03 00:00:00'"), F.expr("TIMESTAMP_NTZ '2024-01-09 12:00:00'")) & F.col("event_type").isin("click", "view", "purchase"))
    return e.orderBy(F.desc("ts"), "event_id").limit(500).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1")
def aggregate_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.sum(k).alias("k_sum")))


@query("SELECT user_id, event_id, event_type, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS r FROM events) WHERE r = 1")
def latest(spark, sf_dir):
    d = patterns.latest(table(spark, sf_dir, "events"), [F.col("ts").desc_nulls_last(), F.col("event_id").asc()], ["user_id"])
    return rounded(d.select("user_id", "event_id", "event_type", "value"))


@query(f"WITH {HOURS} SELECT entity, time, CASE WHEN count(value) OVER w24 = 24 THEN round(avg(value) OVER w24, 4) END AS mean_24, CASE WHEN count(value) OVER w8 = 8 THEN round(avg(value) OVER w8, 4) END AS mean_8 FROM h WINDOW w24 AS (PARTITION BY entity ORDER BY time ROWS 23 PRECEDING), w8 AS (PARTITION BY entity ORDER BY time ROWS 7 PRECEDING)")
def trailing(spark, sf_dir):
    return rounded(patterns.trailing_means(hours(spark, sf_dir), {"mean_24": ("value", 24), "mean_8": ("value", 8)}).drop("value"))


@query(f"""WITH {HOURS}, p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY time) AS p FROM h),
o AS (SELECT entity, p, CASE WHEN p - lag(p) OVER (PARTITION BY entity ORDER BY p) - 1 > 3 THEN 1 ELSE 0 END AS g FROM p WHERE value > 60),
s AS (SELECT entity, p, sum(g) OVER (PARTITION BY entity ORDER BY p) AS seg FROM o), b AS (SELECT entity, seg, min(p) AS a, max(p) AS z FROM s GROUP BY 1, 2),
e AS (SELECT b.entity, seg, min(time) AS start_time, max(time) AS end_time, count(*) AS duration, max(value) AS peak, arg_max(time, struct_pack(v := value, k := -p.p)) AS peak_time, avg(value) AS mean, count(*) FILTER (value > 60) AS n_over FROM b JOIN p ON p.entity = b.entity AND p.p BETWEEN a AND z GROUP BY 1, 2)
SELECT entity, start_time, end_time, duration, round(peak, 4) AS peak, peak_time, round(mean, 4) AS mean, n_over, row_number() OVER (ORDER BY peak DESC, duration DESC, entity, start_time) AS place FROM e WHERE duration >= 2""")
def episodes(spark, sf_dir):
    return rounded(patterns.episodes(hours(spark, sf_dir), 60.0)).select("entity", "start_time", "end_time", "duration", "peak", "peak_time", "mean", "n_over", "place")


_H24 = ", ".join(f"round(max(m) FILTER (k = {i}), 4) AS h{i:02d}" for i in range(24))


@query(f"""WITH {HOURS}, m AS (SELECT entity, hour(time) AS k, avg(value) AS m FROM h GROUP BY 1, 2),
a AS (SELECT CAST(NULL AS VARCHAR) AS entity, k, CASE WHEN count(*) = (SELECT count(DISTINCT entity) FROM m) THEN avg(m) END AS m FROM m GROUP BY k), u AS (SELECT * FROM m UNION ALL SELECT * FROM a),
e AS (SELECT entity, CAST(arg_max(k, struct_pack(m := m, k := -k)) FILTER (m IS NOT NULL) AS INT) AS peak_hour, CAST(arg_min(k, struct_pack(m := m, k := k)) FILTER (m IS NOT NULL) AS INT) AS trough_hour, round(max(m) - min(m), 4) AS amplitude FROM u GROUP BY 1),
w AS (SELECT entity, {_H24} FROM u GROUP BY 1) SELECT w.*, peak_hour, trough_hour, amplitude FROM w JOIN e ON w.entity IS NOT DISTINCT FROM e.entity""")
def hour_profile(spark, sf_dir):
    return rounded(patterns.hour_profile(hours(spark, sf_dir)))


@query(f"WITH {DAYS}, m AS (SELECT entity, avg(value) FILTER (isodow(date) < 6) AS a, avg(value) FILTER (isodow(date) >= 6) AS b FROM d GROUP BY 1) SELECT entity, round(a, 2) AS weekday_mean, round(b, 2) AS weekend_mean, round(b - a, 2) AS delta FROM m")
def weekday_contrast(spark, sf_dir):
    return rounded(patterns.weekday_contrast(days(spark, sf_dir).withColumnRenamed("date", "time")), 2)


@query(f"WITH {DAYS} SELECT entity, strftime(date, '%Y-%m') AS month, count(value) AS n, round(avg(value), 2) AS mean, round(max(value), 2) AS max, round(min(value), 2) AS min FROM d GROUP BY 1, 2")
def monthly(spark, sf_dir):
    return rounded(patterns.monthly(days(spark, sf_dir).withColumnRenamed("date", "time")), 2)


@query(f"WITH {DAYS} SELECT strftime(date_trunc('month', date), '%Y-%m-%d') AS bucket, round(avg(value), 2) AS mean, count(*) AS n FROM d GROUP BY 1")
def month_trend(spark, sf_dir):
    return rounded(patterns.trend(days(spark, sf_dir).withColumnRenamed("date", "time"), "month").withColumn("bucket", F.col("bucket").cast("string")), 2)


@query(f"WITH {HOURS} SELECT strftime(time, '%Y-%m-%d') AS bucket, round(avg(value), 4) AS mean, count(*) AS n FROM h GROUP BY 1")
def day_trend(spark, sf_dir):
    return rounded(patterns.trend(hours(spark, sf_dir)).withColumn("bucket", F.col("bucket").cast("string")))


@query(f"WITH {HOURS} SELECT entity, round(avg(value), 4) AS mean, round(max(value), 4) AS max, round(min(value), 4) AS min, round(quantile_cont(value, 0.95), 4) AS p95, count(*) AS n FROM h GROUP BY 1")
def compare(spark, sf_dir):
    return rounded(patterns.compare(hours(spark, sf_dir)))


@query(f"WITH {HOURS}, f AS (SELECT *, CASE WHEN value > 60 THEN 1 ELSE 0 END AS flag FROM h) SELECT entity, CASE WHEN NOT bool_and(flag > 0) THEN min(time) FILTER (flag > 0) END AS boundary FROM f GROUP BY 1")
def boundary(spark, sf_dir):
    return patterns.boundary(hours(spark, sf_dir).withColumn("flag", (F.col("value") > 60).cast("int")), "flag")


# --- statistics ------------------------------------------------------------------------------------


@query(f"WITH {HOURS}, q AS (SELECT entity, count(value) AS count, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS p FROM h GROUP BY 1) SELECT entity, count, round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min, round(max, 4) AS max, round(p[1], 4) AS p5, round(p[2], 4) AS p25, round(p[3], 4) AS p50, round(p[4], 4) AS p75, round(p[5], 4) AS p95, round(max - min, 4) AS range, round(p[4] - p[2], 4) AS iqr, round(std / abs(mean), 4) AS cv FROM q")
def describe(spark, sf_dir):
    return rounded(stats.describe(hours(spark, sf_dir), "value", ["entity"]))


_FENCES = "f AS (SELECT entity, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM h GROUP BY 1), g AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low_fence, q3 + 1.5 * (q3 - q1) AS high_fence FROM f)"


@query(f"WITH {HOURS}, {_FENCES} SELECT entity, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3, round(any_value(low_fence), 4) AS low_fence, round(any_value(high_fence), 4) AS high_fence, round(min(value) FILTER (value BETWEEN low_fence AND high_fence), 4) AS low_whisker, round(max(value) FILTER (value BETWEEN low_fence AND high_fence), 4) AS high_whisker, count(*) FILTER (value < low_fence OR value > high_fence) AS n_outliers FROM h JOIN g USING (entity) GROUP BY 1")
def boxplot(spark, sf_dir):
    return rounded(stats.boxplot(hours(spark, sf_dir), "value", ["entity"]).drop("outliers"))


@query(f"WITH {HOURS}, {_FENCES} SELECT entity, count(*) AS n, count(*) FILTER (value < low_fence OR value > high_fence) AS n_outliers FROM h JOIN g USING (entity) GROUP BY 1")
def fence_outliers(spark, sf_dir):
    return stats.fence_outliers(hours(spark, sf_dir), "value", ["entity"])


@query("""WITH r AS (SELECT l_returnflag AS flag, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS total FROM lineitem GROUP BY 1),
c AS (SELECT l_returnflag AS flag, CAST(least(floor((l_quantity - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM lineitem JOIN r ON flag = l_returnflag GROUP BY 1, 2)
SELECT r.flag, CAST(b.bin AS INT) AS bin, round(lo + b.bin * ((hi - lo) / 20), 4) AS left_edge, round(lo + (b.bin + 1) * ((hi - lo) / 20), 4) AS right_edge, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / total, 4) AS percent FROM r CROSS JOIN (SELECT unnest(range(20)) AS bin) b LEFT JOIN c ON c.flag = r.flag AND c.bin = b.bin""")
def histogram(spark, sf_dir):
    return rounded(stats.histogram(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), "l_quantity", ["flag"]))


@query("""WITH r AS (SELECT l_returnflag AS flag, l_quantity AS x, l_extendedprice AS y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
SELECT flag, count(*) AS samples, round(corr(x, y), 4) AS pearson, round(corr(rx, ry), 4) AS spearman, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 4) AS r2 FROM r GROUP BY 1""")
def pair(spark, sf_dir):
    return rounded(stats.pair(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["flag"]))


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 4) AS r FROM lineitem" for a, b in combinations(_NUMERIC, 2)) + ")")
def correlation_pairs(spark, sf_dir):
    return rounded(stats.correlation_pairs(table(spark, sf_dir, "lineitem"), _NUMERIC))


@query("WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT CAST(least(floor((l_quantity - lo) / (hi - lo) * 12), 11) AS INT) AS bin, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, count(*) AS n FROM lineitem, r GROUP BY 1")
def binned_curve(spark, sf_dir):
    return rounded(stats.binned_curve(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 12))


@query("""WITH z AS (SELECT event_type, event_id, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY event_type)),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(z) DESC, event_id) AS place FROM z WHERE abs(z) > 3) SELECT event_type, event_id, round(z, 4) AS z FROM k WHERE place <= 60""")
def z_outliers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return rounded(stats.outliers(e, "value", ["event_type"]).select("event_type", "event_id", "z"))


@query(f"WITH {HOURS}, m AS (SELECT entity, quantile_cont(value, 0.5) AS med FROM h GROUP BY 1), v AS (SELECT h.*, med, abs(value - med) AS dev FROM h JOIN m USING (entity)), a AS (SELECT entity, quantile_cont(dev, 0.5) AS mad FROM v GROUP BY 1) SELECT entity, time, round(CASE WHEN mad > 0 THEN 0.6745 * (value - med) / mad ELSE 0 END, 4) AS z FROM v JOIN a USING (entity)")
def robust_z(spark, sf_dir):
    return rounded(stats.robust_z(hours(spark, sf_dir), "value", ["entity"]).select("entity", "time", "z"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE (k - 1) % greatest(1, n // 300) = 0")
def thinned(spark, sf_dir):
    return stats.thinned(table(spark, sf_dir, "events").select("event_type", "event_id", "ts"), ["event_type"], ["ts", "event_id"], 300).select("event_type", "event_id")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std, count(*) FILTER ({c} < 1 OR {c} > 45) AS out_of_range FROM lineitem" for c in _NUMERIC))
def column_profile(spark, sf_dir):
    return rounded(stats.column_profile(table(spark, sf_dir, "lineitem"), _NUMERIC, {c: (1, 45) for c in _NUMERIC}))


# --- reports ---------------------------------------------------------------------------------------

_BOUNDS = [1e5, 2e5, 3e5, 5e5]
_NAMES = ["a", "b", "c", "d", "e"]
_LEVEL = "CASE " + " ".join(f"WHEN value <= {b} THEN '{x}'" for b, x in zip(_BOUNDS, _NAMES, strict=False)) + f" ELSE '{_NAMES[-1]}' END"


@query(f"WITH {DAYS}, l AS (SELECT *, {_LEVEL} AS level FROM d) SELECT entity, count(*) AS days, count(*) FILTER (value <= 300000) AS good_days, count(*) FILTER (value > 300000) AS exceed_days, CAST(80.0 AS DOUBLE) AS target, 100.0 * count(*) FILTER (value <= 300000) / count(*) >= 80 AS target_met, round(avg(value), 2) AS mean, round(max(value), 2) AS peak, " + ", ".join(f"count(*) FILTER (level = '{x}') AS days_{x}" for x in _NAMES) + ", round(100.0 * count(*) FILTER (value <= 300000) / count(*), 2) AS good_percent, round(100.0 * count(*) FILTER (value <= 300000) / count(*) - 80, 2) AS gap FROM l GROUP BY GROUPING SETS ((entity), ())")
def compliance(spark, sf_dir):
    return rounded(report.compliance(days(spark, sf_dir), 3e5, F.expr(_LEVEL), _NAMES), 2)


@query(f"WITH {DAYS}, m AS (SELECT entity, avg(value) FILTER (DATE '2000-06-30' - date BETWEEN 0 AND 89) AS a, avg(value) FILTER (DATE '2000-06-30' - date BETWEEN 90 AND 179) AS b, count(*) FILTER (DATE '2000-06-30' - date BETWEEN 0 AND 89) AS na, count(*) FILTER (DATE '2000-06-30' - date BETWEEN 90 AND 179) AS nb FROM d WHERE date BETWEEN DATE '2000-06-30' - 179 AND DATE '2000-06-30' GROUP BY 1) SELECT entity, round(a, 2) AS current, round(b, 2) AS previous, na AS current_days, nb AS previous_days, round(a - b, 2) AS delta, round(100.0 * (a - b) / abs(b), 2) AS percent, CASE WHEN a - b IS NULL THEN '数据不足' WHEN a < b THEN '改善' WHEN a > b THEN '转差' ELSE '持平' END AS trend FROM m WHERE na > 0")
def period_change(spark, sf_dir):
    return rounded(report.period_change(days(spark, sf_dir), "2000-06-30", 90), 2)


@query(f"WITH {DAYS} SELECT a.entity, count(*) AS days, round(avg(a.value), 2) AS this_year, round(avg(b.value), 2) AS last_year, round(avg(a.value - b.value), 2) AS change FROM d a JOIN d b ON a.entity = b.entity AND b.date = CAST(a.date - INTERVAL 12 MONTH AS DATE) GROUP BY 1")
def year_change(spark, sf_dir):
    return rounded(report.year_change(days(spark, sf_dir)), 2)


@query(f"WITH {DAYS} SELECT entity, strftime(arg_min(date, struct_pack(v := value, k := date)), '%Y-%m-%d') AS best_day, round(min(value), 2) AS best, strftime(arg_max(date, struct_pack(v := value, k := -(date - DATE '1970-01-01'))), '%Y-%m-%d') AS worst_day, round(max(value), 2) AS worst, round(avg(value), 2) AS mean FROM d GROUP BY 1")
def extremes(spark, sf_dir):
    return rounded(report.extremes(days(spark, sf_dir)), 2).withColumns({c: F.col(c).cast("string") for c in ("best_day", "worst_day")})


@query(f"WITH {DAYS}, m AS (SELECT entity, avg(value) AS a, max(value) AS b FROM d GROUP BY 1), u AS (SELECT entity, 'mean' AS ranking, a AS score FROM m UNION ALL SELECT entity, 'least', -a FROM m UNION ALL SELECT entity, 'peak', b FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY ranking ORDER BY score DESC, entity) AS place FROM u) SELECT entity, ranking, round(score, 2) AS score, place FROM k WHERE place <= 5")
def rankings(spark, sf_dir):
    m = days(spark, sf_dir).groupBy("entity").agg(F.avg("value").alias("a"), F.max("value").alias("b"))
    return rounded(report.rankings(m, {"mean": F.col("a"), "least": -F.col("a"), "peak": F.col("b")}, 5), 2)


# --- joins -------------------------------------------------------------------------------------------


@query("WITH a AS (SELECT user_id, date_trunc('hour', ts) AS time, max(value) AS value, count(*) AS n_a FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2), b AS (SELECT user_id, date_trunc('hour', ts) AS time, max(value) AS value, count(*) AS n_b FROM events WHERE event_type NOT IN ('click') GROUP BY 1, 2) SELECT user_id, time, round(coalesce(a.value, b.value), 4) AS value, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b USING (user_id, time)")
def fuse(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("time", patterns.hour(F.col("ts")))
    side = lambda d, n: d.groupBy("user_id", "time").agg(F.max("value").alias("value"), F.count("*").alias(n))
    return rounded(joins.fuse(side(e.where("event_type IN ('click', 'view')"), "n_a"), side(e.where("event_type NOT IN ('click')"), "n_b"), ["user_id", "time"]).fillna(0, ["n_a", "n_b"]))


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dimension_lookup(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    d = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "left")
    return d.select("s_suppkey", "s_name", "n_name", "r_name")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderdate < TIMESTAMP '1998-01-01' AND NOT EXISTS (SELECT 1 FROM (SELECT o_custkey AS c, max(o_orderkey) AS k FROM orders GROUP BY 1) WHERE c = o.o_custkey AND k = o.o_orderkey)")
def superseded(spark, sf_dir):
    return joins.superseded(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate", F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")).select("o_orderkey", "o_custkey")


@query("WITH h AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier WHERE s_suppkey % 3 <> 0), w AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 99 ELSE s_nationkey END AS v FROM supplier WHERE s_suppkey % 4 <> 0) SELECT k, coalesce(h.v, -1) AS old, coalesce(w.v, -1) AS new, CASE WHEN h.v IS NULL THEN 'create' WHEN w.v IS NULL THEN 'delete' WHEN h.v = w.v THEN 'keep' ELSE 'update' END AS action FROM h FULL JOIN w USING (k)")
def sync(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    changed = s.where("k % 4 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, 99).otherwise(F.col("v")))
    return joins.sync(s.where("k % 3 <> 0"), changed, ["k"], "v").fillna(-1, ["old", "new"])


_AT = "CAST({k} * 37 % 120 AS DOUBLE) / 2 - 30 AS lat, CAST({k} * 53 % 360 AS DOUBLE) - 180 AS lon"


@query(f"""WITH p AS (SELECT c_custkey AS id, {_AT.format(k='c_custkey')} FROM customer), c AS (SELECT s_suppkey AS cand_id, {_AT.format(k='(s_suppkey + 7)')} FROM supplier),
d AS (SELECT id, cand_id, 2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * power(sin(radians(c.lon - p.lon) / 2), 2)))) AS km FROM p, c)
SELECT id, arg_min(cand_id, struct_pack(km := km, c := cand_id)) AS cand_id, round(min(km), 3) AS km, min(km) > 300 AS far FROM d GROUP BY 1""")
def nearest(spark, sf_dir):
    at = lambda d, key, k, name: d.select(F.col(key).alias(name), (F.expr(f"CAST({k} * 37 % 120 AS DOUBLE) / 2 - 30")).alias("lat"), F.expr(f"CAST({k} * 53 % 360 AS DOUBLE) - 180").alias("lon"))
    p, c = at(table(spark, sf_dir, "customer"), "c_custkey", "c_custkey", "id"), at(table(spark, sf_dir, "supplier"), "s_suppkey", "(s_suppkey + 7)", "cand_id")
    return rounded(joins.nearest(p, c, 300.0), 3)


# --- domain expressions and derivations ----------------------------------------------------------------

#: Concentrations and weather made from columns of lineitem.
_GRID = {
    "pm2_5": "l_quantity * 6.0", "pm10": "l_extendedprice / 160.0", "ozone": "CAST(l_partkey % 900 AS DOUBLE)", "nitrogen_dioxide": "CAST(l_orderkey % 1000 AS DOUBLE)", "sulphur_dioxide": "CAST(l_partkey % 1700 AS DOUBLE)", "carbon_monoxide": "CAST(l_orderkey % 60 AS DOUBLE) * 1000.0",
    "european_aqi": "l_quantity * 2.5", "temperature_2m": "l_quantity - 12.5", "relative_humidity_2m": "CAST(l_linenumber * 13 AS DOUBLE)", "wind_speed_10m": "l_discount * 600.0", "precipitation": "l_tax * 120.0", "wind_gusts_10m": "l_discount * 900.0", "visibility": "l_extendedprice / 10.0", "uv_index": "l_quantity / 4.5",
}


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(e).alias(c) for c, e in _GRID.items()))


GRID = "g AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, " + ", ".join(f"{e} AS {c}" for c, e in _GRID.items()) + " FROM lineitem)"


# The tables of the standards once more, as literals: an error in the code's tables shows.
_BREAKS = """bp(p, lo, hi, a, b, top) AS (VALUES
('pm2_5', 0, 35, 0, 50, 500), ('pm2_5', 35, 75, 50, 100, 500), ('pm2_5', 75, 115, 100, 150, 500), ('pm2_5', 115, 150, 150, 200, 500), ('pm2_5', 150, 250, 200, 300, 500), ('pm2_5', 250, 350, 300, 400, 500), ('pm2_5', 350, 500, 400, 500, 500),
('pm10', 0, 50, 0, 50, 600), ('pm10', 50, 150, 50, 100, 600), ('pm10', 150, 250, 100, 150, 600), ('pm10', 250, 350, 150, 200, 600), ('pm10', 350, 420, 200, 300, 600), ('pm10', 420, 500, 300, 400, 600), ('pm10', 500, 600, 400, 500, 600),
('sulphur_dioxide', 0, 50, 0, 50, 2620), ('sulphur_dioxide', 50, 150, 50, 100, 2620), ('sulphur_dioxide', 150, 475, 100, 150, 2620), ('sulphur_dioxide', 475, 800, 150, 200, 2620), ('sulphur_dioxide', 800, 1600, 200, 300, 2620), ('sulphur_dioxide', 1600, 2100, 300, 400, 2620), ('sulphur_dioxide', 2100, 2620, 400, 500, 2620),
('nitrogen_dioxide', 0, 40, 0, 50, 940), ('nitrogen_dioxide', 40, 80, 50, 100, 940), ('nitrogen_dioxide', 80, 180, 100, 150, 940), ('nitrogen_dioxide', 180, 280, 150, 200, 940), ('nitrogen_dioxide', 280, 565, 200, 300, 940), ('nitrogen_dioxide', 565, 750, 300, 400, 940), ('nitrogen_dioxide', 750, 940, 400, 500, 940),
('carbon_monoxide', 0, 2000, 0, 50, 60000), ('carbon_monoxide', 2000, 4000, 50, 100, 60000), ('carbon_monoxide', 4000, 14000, 100, 150, 60000), ('carbon_monoxide', 14000, 24000, 150, 200, 60000), ('carbon_monoxide', 24000, 36000, 200, 300, 60000), ('carbon_monoxide', 36000, 48000, 300, 400, 60000), ('carbon_monoxide', 48000, 60000, 400, 500, 60000),
('ozone', 0, 100, 0, 50, 800), ('ozone', 100, 160, 50, 100, 800), ('ozone', 160, 215, 100, 150, 800), ('ozone', 215, 265, 150, 200, 800), ('ozone', 265, 800, 200, 300, 800)),
ld(p, k, lo, hi) AS (VALUES ('pm2_5', 0, 0, 35), ('pm2_5', 1, 35, 75), ('pm2_5', 2, 75, 115), ('pm2_5', 3, 115, 150), ('pm2_5', 4, 150, 250), ('pm10', 0, 0, 50), ('pm10', 1, 50, 150), ('pm10', 2, 150, 250), ('pm10', 3, 250, 350), ('pm10', 4, 350, 420),
('ozone', 0, 0, 100), ('ozone', 1, 100, 160), ('ozone', 2, 160, 215), ('ozone', 3, 215, 265), ('ozone', 4, 265, 800), ('nitrogen_dioxide', 0, 0, 40), ('nitrogen_dioxide', 1, 40, 80), ('nitrogen_dioxide', 2, 80, 180), ('nitrogen_dioxide', 3, 180, 280), ('nitrogen_dioxide', 4, 280, 565),
('sulphur_dioxide', 0, 0, 50), ('sulphur_dioxide', 1, 50, 150), ('sulphur_dioxide', 2, 150, 475), ('sulphur_dioxide', 3, 475, 800), ('sulphur_dioxide', 4, 800, 1600), ('carbon_monoxide', 0, 0, 2000), ('carbon_monoxide', 1, 2000, 4000), ('carbon_monoxide', 2, 4000, 14000), ('carbon_monoxide', 3, 14000, 24000), ('carbon_monoxide', 4, 24000, 36000)),
nm(p, label, ai, al) AS (VALUES ('pm2_5', 'PM2.5', 1, 1), ('pm10', 'PM10', 2, 2), ('sulphur_dioxide', 'SO₂', 3, 5), ('nitrogen_dioxide', 'NO₂', 4, 4), ('carbon_monoxide', 'CO', 5, 6), ('ozone', 'O₃', 6, 3))"""
_EURO = "CASE WHEN {c} IS NULL THEN NULL WHEN {c} <= 20 THEN '优' WHEN {c} <= 40 THEN '良' WHEN {c} <= 60 THEN '轻度污染' WHEN {c} <= 80 THEN '中度污染' WHEN {c} <= 100 THEN '重度污染' ELSE '严重污染' END"
_CHINA = "CASE WHEN {c} IS NULL THEN {null} WHEN {c} <= 50 THEN '优' WHEN {c} <= 100 THEN '良' WHEN {c} <= 150 THEN '轻度污染' WHEN {c} <= 200 THEN '中度污染' WHEN {c} <= 300 THEN '重度污染' ELSE '严重污染' END"


def _sql_indices(source: str, raw: str) -> str:
    """CTEs: bi (rid, aqi, primary_i) of the columns of ``source`` and bl (rid, load_primary) of those of ``raw``, which
    have rid and the pollutants."""
    long = lambda t: " UNION ALL ".join(f"SELECT rid, '{p}' AS p, CAST({p} AS DOUBLE) AS v FROM {t}" for p in ("pm2_5", "pm10", "sulphur_dioxide", "nitrogen_dioxide", "carbon_monoxide", "ozone"))
    return f"""{_BREAKS}, ui AS ({long(source)}), ul AS ({long(raw)}),
si AS (SELECT u.rid, u.p, CASE WHEN u.v >= t.top THEN 500.0 ELSE ROUND(bp.a + (u.v - bp.lo) / (bp.hi - bp.lo) * (bp.b - bp.a), 2) END AS x FROM ui u JOIN (SELECT p, max(top) AS top FROM bp GROUP BY 1) t ON t.p = u.p LEFT JOIN bp ON bp.p = u.p AND u.v <= bp.hi AND (u.v > bp.lo OR bp.lo = 0) WHERE u.v >= 0),
sl AS (SELECT u.rid, u.p, coalesce(ld.k + (u.v - ld.lo) / (ld.hi - ld.lo), 6.0) AS x FROM ul u LEFT JOIN ld ON ld.p = u.p AND u.v <= ld.hi AND (u.v > ld.lo OR ld.lo = 0) WHERE u.v >= 0),
bi AS (SELECT rid, max(x) AS aqi, CASE WHEN max(x) > 50 THEN arg_max(label, struct_pack(x := x, k := -ai)) ELSE '无' END AS primary_i FROM si JOIN nm USING (p) GROUP BY 1),
bl AS (SELECT rid, CASE WHEN max(x) > 0.5 THEN arg_max(label, struct_pack(x := x, k := -al)) ELSE '无' END AS load_primary FROM sl JOIN nm USING (p) GROUP BY 1)"""


@query(f"WITH {GRID}, {_sql_indices('g', 'g')} SELECT l_orderkey, l_linenumber, round(aqi, 1) AS aqi, {_CHINA.format(c='aqi', null=repr(''))} AS level, {_EURO.format(c='european_aqi')} AS european_level, load_primary FROM g LEFT JOIN bi USING (rid) LEFT JOIN bl USING (rid)")
def air_indices(spark, sf_dir):
    d = S.compilable(grid(spark, sf_dir))
    d = d.withColumns({"best": S.best_iaqi({k: F.col(k) for k in S.IAQI_POINTS}), "load": S.best_load({k: F.col(k) for k in S.LOAD_POINTS})})
    c = S.china_of(F.col("best"), list(S.IAQI_POINTS))
    return rounded(d.select("l_orderkey", "l_linenumber", c["aqi"].alias("aqi"), c["level"].alias("level"), S.aqi_level(F.col("european_aqi")).alias("european_level"), S.primary_of(F.col("load"), list(S.LOAD_POINTS)).alias("load_primary")), 1)


@query(f"WITH {GRID}, t AS (SELECT *, temperature_2m * 1.8 AS f FROM g) SELECT l_orderkey, l_linenumber, round(ROUND(greatest(0, least(100, 100 - abs(f + 32 - (0.55 - 0.0055 * relative_humidity_2m) * (f - 26) - 70) * 3.2 + CASE WHEN wind_speed_10m <= 20 THEN 3 WHEN wind_speed_10m > 40 THEN -least(18, (wind_speed_10m - 40) * 0.45) ELSE 0 END)), 2), 1) AS comfort, round(ROUND(wind_speed_10m / 3.6 * 600, 2), 1) AS ventilation, CAST(wind_speed_10m < 8 AND precipitation < 0.1 AS INT) AS stagnant FROM t")
def weather_measures(spark, sf_dir):
    w = F.col("wind_speed_10m")
    return rounded(grid(spark, sf_dir).select("l_orderkey", "l_linenumber", S.comfort_index(F.col("temperature_2m"), F.col("relative_humidity_2m"), w).alias("comfort"), S.ventilation_index(w).alias("ventilation"), S.is_stagnant(w, F.col("precipitation")).alias("stagnant")), 1)


_RULES = """SELECT rid, 'air.severe_pollution' AS key, 'european_aqi' AS metric, 'severe' AS severity, 0 AS r, -100 AS strict FROM g WHERE european_aqi >= 100
UNION ALL SELECT rid, 'air.heavy_pollution', 'european_aqi', 'severe', 0, -80 FROM g WHERE european_aqi >= 80
UNION ALL SELECT rid, 'air.moderate_pollution', 'european_aqi', 'warning', 1, -60 FROM g WHERE european_aqi >= 60
UNION ALL SELECT rid, 'air.light_pollution', 'european_aqi', 'info', 2, -40 FROM g WHERE european_aqi >= 40
UNION ALL SELECT rid, 'weather.heat_wave', 'temperature_2m', 'severe', 0, -35 FROM g WHERE temperature_2m >= 35
UNION ALL SELECT rid, 'weather.heat_warning', 'temperature_2m', 'warning', 1, -32 FROM g WHERE temperature_2m >= 32
UNION ALL SELECT rid, 'weather.frost', 'temperature_2m', 'severe', 0, -10 FROM g WHERE temperature_2m <= -10
UNION ALL SELECT rid, 'weather.gale', 'wind_speed_10m', 'warning', 1, -50 FROM g WHERE wind_speed_10m >= 50
UNION ALL SELECT rid, 'weather.strong_gust', 'wind_gusts_10m', 'warning', 1, -75 FROM g WHERE wind_gusts_10m >= 75
UNION ALL SELECT rid, 'weather.heavy_rain', 'precipitation', 'severe', 0, -8 FROM g WHERE precipitation >= 8
UNION ALL SELECT rid, 'weather.low_visibility', 'visibility', 'warning', 1, 1000 FROM g WHERE visibility <= 1000
UNION ALL SELECT rid, 'weather.high_uv', 'uv_index', 'info', 2, -8 FROM g WHERE uv_index >= 8"""


@query(f"WITH {GRID}, u AS ({_RULES}), k AS (SELECT *, row_number() OVER (PARTITION BY rid, metric ORDER BY r, strict) AS n FROM u) SELECT severity, key, count(*) AS n FROM k WHERE n = 1 GROUP BY 1, 2")
def alerts(spark, sf_dir):
    metrics = {m: F.col(m) for _, m, *_ in S.ALERTS}
    d = grid(spark, sf_dir).select(F.explode(S.alerts(metrics)).alias("a"))
    return d.groupBy("a.severity", "a.key").agg(F.count("*").alias("n"))


def _city_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("city_id"), patterns.hour(F.col("ts")).alias("time"))
    v = F.avg("value")
    return e.agg(v.alias("pm2_5"), (v * 1.6).alias("pm10"), (v * 2).alias("ozone"), (v / 2).alias("nitrogen_dioxide"), (v / 3).alias("sulphur_dioxide"), (v * 9).alias("carbon_monoxide"), (v / 2).alias("european_aqi"), (v / 4).alias("temperature_2m"), (v / 3).alias("relative_humidity_2m"), (v / 9).alias("wind_speed_10m"), (v / 1000).alias("precipitation"))


#: Hours of a city with what the derivation makes of them.
_ENV = f"""{HOURS}, r AS (SELECT row_number() OVER (ORDER BY entity, time) AS rid, entity AS city_id, time, value AS pm2_5, value * 1.6 AS pm10, value * 2 AS ozone, value / 2 AS nitrogen_dioxide, value / 3 AS sulphur_dioxide, value * 9 AS carbon_monoxide, value / 2 AS european_aqi, value / 4 AS temperature_2m, value / 3 AS relative_humidity_2m, value / 9 AS wind_speed_10m, value / 1000 AS precipitation FROM h),
m AS (SELECT rid, CASE WHEN count(*) OVER w24 = 24 THEN avg(pm2_5) OVER w24 END AS pm2_5, CASE WHEN count(*) OVER w24 = 24 THEN avg(pm10) OVER w24 END AS pm10, CASE WHEN count(*) OVER w8 = 8 THEN avg(ozone) OVER w8 END AS ozone, nitrogen_dioxide, sulphur_dioxide, carbon_monoxide FROM r WINDOW w24 AS (PARTITION BY city_id ORDER BY time ROWS 23 PRECEDING), w8 AS (PARTITION BY city_id ORDER BY time ROWS 7 PRECEDING)),
{_sql_indices('m', 'r')}"""


@query(f"""WITH {_ENV} SELECT city_id, time, {', '.join(f'round({c}, 4) AS {c}' for c in ('pm2_5', 'pm10', 'ozone', 'nitrogen_dioxide', 'sulphur_dioxide', 'carbon_monoxide', 'european_aqi', 'temperature_2m', 'relative_humidity_2m', 'wind_speed_10m', 'precipitation'))}, round(aqi, 1) AS china_aqi, {_CHINA.format(c='aqi', null=repr(''))} AS china_aqi_level, primary_i AS china_primary_pollutant, {_EURO.format(c='european_aqi')} AS aqi_level, load_primary AS primary_pollutant,
round(ROUND(greatest(0, least(100, 100 - abs(temperature_2m * 1.8 + 32 - (0.55 - 0.0055 * relative_humidity_2m) * (temperature_2m * 1.8 - 26) - 70) * 3.2 + CASE WHEN wind_speed_10m <= 20 THEN 3 WHEN wind_speed_10m > 40 THEN -least(18, (wind_speed_10m - 40) * 0.45) ELSE 0 END)), 2), 1) AS comfort_index, round(ROUND(wind_speed_10m / 3.6 * 600, 2), 1) AS ventilation_index, CAST(wind_speed_10m < 8 AND precipitation < 0.1 AS INT) AS is_stagnant FROM r LEFT JOIN bi USING (rid) LEFT JOIN bl USING (rid)""")
def derive_hourly(spark, sf_dir):
    """Indices are compared to one digit, as the two engines' means differ in the last bits."""
    d = derive.hourly(_city_hours(spark, sf_dir))
    coarse = ["china_aqi", "comfort_index", "ventilation_index"]
    return rounded(d).withColumns({c: F.round(F.col(c) + OFF_TIES, 1) for c in coarse})


@query(f"""WITH {HOURS}, o AS (SELECT *, CASE WHEN count(value) OVER w = 8 THEN avg(value * 2) OVER w END AS o8 FROM h WINDOW w AS (PARTITION BY entity ORDER BY time ROWS 7 PRECEDING))
SELECT entity AS city_id, strftime(time, '%Y-%m-%d') AS date, round(avg(value / 4), 4) AS temp_avg, round(max(value / 4), 4) AS temp_max, round(min(value / 4), 4) AS temp_min, round(sum(value / 1000), 4) AS precipitation_sum, round(max(value / 2), 4) AS aqi_max, round(avg(value), 4) AS pm2_5, round(max(o8), 4) AS ozone, count(*) AS obs_hours, CAST(count(*) FILTER (value / 9 < 8 AND value / 1000 < 0.1) AS BIGINT) AS stagnant_hours FROM o GROUP BY 1, 2""")
def derive_daily(spark, sf_dir):
    d = derive.daily(derive.hourly(_city_hours(spark, sf_dir)))
    return rounded(d.select("city_id", F.col("date").cast("string").alias("date"), "temp_avg", "temp_max", "temp_min", "precipitation_sum", "aqi_max", "pm2_5", "ozone", "obs_hours", F.col("stagnant_hours").cast("bigint").alias("stagnant_hours")))


# --- quality, similarity, lineage -------------------------------------------------------------------------


def _checks() -> list[quality.Check]:
    return [
        quality.Check("null_rate", "completeness", quality.null_rate(["v", "t"]), "critical"),
        quality.Check("range", "validity", quality.in_range("v", 0, 200)),
        quality.Check("enum", "validity", quality.in_set("event_type", ["click", "view", "purchase"]), "minor"),
        quality.Check("key", "uniqueness", quality.unique(["key"]), "critical"),
        quality.Check("rule", "consistency", quality.holds(F.col("v") <= 300)),
    ]


_WEIGHTS = {"completeness": 0.3, "validity": 0.3, "uniqueness": 0.2, "consistency": 0.2}
_VIOLATED = "x AS (SELECT event_type, CASE WHEN event_id % 11 <> 0 THEN value END AS v, CASE WHEN event_id % 13 <> 0 THEN ts END AS t, event_id // 2 AS key FROM events)"
_SCORED = f"""WITH {_VIOLATED}, s AS (SELECT round((100.0 * count(v) / count(*) + 100.0 * count(t) / count(*)) / 2, 2) AS null_rate, round(100.0 * (1 - count(*) FILTER (NOT v BETWEEN 0 AND 200) / count(v)), 2) AS range, round(100.0 * (1 - count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) / count(event_type)), 2) AS enum, round(100.0 * count(DISTINCT key) / count(*), 2) AS key, round(100.0 * (1 - count(*) FILTER (NOT v <= 300) / count(v)), 2) AS rule FROM x),
u AS (SELECT 'null_rate' AS "check", 'completeness' AS dimension, 'critical' AS severity, null_rate AS score FROM s UNION ALL SELECT 'range', 'validity', 'major', range FROM s UNION ALL SELECT 'enum', 'validity', 'minor', enum FROM s UNION ALL SELECT 'key', 'uniqueness', 'critical', key FROM s UNION ALL SELECT 'rule', 'consistency', 'major', rule FROM s)"""


def _violated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_type", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 13 != 0, F.col("ts")).alias("t"), F.floor(F.col("event_id") / 2).alias("key"))


@query(_SCORED + " SELECT *, CASE WHEN score >= 90 THEN 'passed' WHEN score >= 70 THEN 'warning' ELSE 'failed' END AS status FROM u")
def quality_checks(spark, sf_dir):
    return quality.evaluate(_violated(spark, sf_dir), _checks())


@query(_SCORED + ", d AS (SELECT dimension, sum(score * w) / sum(w) AS score FROM (SELECT *, CASE severity WHEN 'critical' THEN 3 WHEN 'major' THEN 2 ELSE 1 END AS w FROM u) GROUP BY 1), t AS (SELECT sum(score * w) / sum(w) AS total, count(*) AS dimensions FROM (SELECT *, CASE dimension WHEN 'completeness' THEN 0.3 WHEN 'validity' THEN 0.3 ELSE 0.2 END AS w FROM d)) SELECT round(total, 2) AS total, dimensions, CASE WHEN total >= 95 THEN 'A' WHEN total >= 85 THEN 'B' WHEN total >= 75 THEN 'C' WHEN total >= 60 THEN 'D' ELSE 'E' END AS grade FROM t")
def quality_roll_up(spark, sf_dir):
    return rounded(quality.roll_up(quality.evaluate(_violated(spark, sf_dir), _checks()), _WEIGHTS), 2)


_FEATURES = f"{DAYS}, m AS (SELECT entity, avg(value) AS a, max(value) AS b FROM d GROUP BY 1), z AS (SELECT entity, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM m)"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = days(spark, sf_dir).groupBy("entity").agg(F.avg("value").alias("a"), F.max("value").alias("b"))
    return stats.standardised(m, ["a", "b"]).select("entity", F.array("a", "b").alias("v"))


@query(f'WITH {_FEATURES}, p AS (SELECT x.entity AS "left", y.entity AS "right", sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2)) AS dist FROM z x JOIN z y ON x.entity < y.entity) SELECT "left", "right", round(dist, 4) AS distance, round(1 - dist / (SELECT max(dist) FROM p), 4) AS similarity FROM p ORDER BY dist, "left", "right" LIMIT 12')
def similarity(spark, sf_dir):
    return rounded(similar.similarity(features(spark, sf_dir)))


@query()
def clusters(spark, sf_dir):
    return similar.cluster(features(spark, sf_dir), 3, restarts=3)


@query()
def silhouette(spark, sf_dir):
    f = features(spark, sf_dir)
    return rounded(similar.silhouette(f, similar.cluster(f, 3, restarts=3)))


#: A graph of suppliers: each follows those of a third and a quarter of its number.
_EDGES = "n AS (SELECT CAST(s_suppkey AS VARCHAR) AS node, s_suppkey AS k FROM supplier), e AS (SELECT DISTINCT CAST(k // 3 AS VARCHAR) AS upstream, node AS downstream, 'join' AS transform FROM n WHERE k > 2 UNION ALL SELECT CAST(k // 4 AS VARCHAR), node, 'copy' FROM n WHERE k > 20 AND k % 5 = 0)"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("node"), F.col("s_suppkey").alias("k"))
    e = lambda rule, by, kind: n.where(rule).select(F.expr(f"CAST(k DIV {by} AS STRING)").alias("upstream"), F.col("node").alias("downstream"), F.lit(kind).alias("transform"))
    return n.select("node"), e("k > 2", 3, "join").unionAll(e("k > 20 AND k % 5 = 0", 4, "copy"))


@query(f"WITH RECURSIVE {_EDGES}, walk AS (SELECT DISTINCT upstream AS node, 0 AS depth FROM e WHERE upstream NOT IN (SELECT downstream FROM e) UNION ALL SELECT e.downstream, w.depth + 1 FROM walk w JOIN e ON e.upstream = w.node) SELECT node, CAST(max(depth) AS INT) AS depth FROM walk GROUP BY 1")
def lineage_depth(spark, sf_dir):
    return lineage.depths(_graph(spark, sf_dir)[1])


@query(f"WITH RECURSIVE {_EDGES}, s AS (SELECT upstream AS a, downstream AS b FROM e UNION SELECT downstream, upstream FROM e), walk AS (SELECT '7' AS node, 0 AS level UNION SELECT s.b, w.level + 1 FROM walk w JOIN s ON s.a = w.node WHERE w.level < 10) SELECT node, CAST(min(level) AS INT) AS level FROM walk GROUP BY 1")
def lineage_trace(spark, sf_dir):
    return lineage.trace(_graph(spark, sf_dir)[1], "7", "both")


@query(f"WITH {_EDGES}, g AS (SELECT node, (SELECT count(*) FROM e WHERE downstream = node) AS u, (SELECT count(*) FROM e WHERE upstream = node) AS d FROM n) SELECT count(*) AS nodes, count(*) FILTER (u = 0 AND d > 0) AS sources, count(*) FILTER (d = 0 AND u > 0) AS sinks, count(*) FILTER (u = 0 AND d = 0) AS isolated, round(avg(u), 2) AS avg_upstream, CAST((SELECT count(*) FROM e) AS BIGINT) AS edges, (SELECT count(*) FROM e WHERE transform = 'copy') AS copies FROM g")
def lineage_summary(spark, sf_dir):
    d = lineage.summary(*_graph(spark, sf_dir))
    return rounded(d.withColumn("copies", F.coalesce(F.try_element_at("transforms", F.lit("copy")), F.lit(0))).drop("transforms"), 2)


# --- summaries: order priorities stand for jobs, order states for their outcome -------------------


@query("""WITH j AS (SELECT l_orderkey, count(*) AS units, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey // 4 AS pipeline, CASE WHEN failed = units THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'success' END AS status FROM j)
SELECT pipeline, count(*) AS jobs, CASE WHEN bool_and(status = 'failed') THEN 'failed' WHEN bool_or(status <> 'success') THEN 'partial' ELSE 'success' END AS status FROM s GROUP BY 1""")
def pipeline_outcome(spark, sf_dir):
    jobs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(summary.job_status(F.count("*"), F.count_if(F.col("l_returnflag") == "R")).alias("status"))
    return jobs.groupBy(F.expr("l_orderkey DIV 4").alias("pipeline")).agg(F.count("*").alias("jobs"), summary.pipeline_status().alias("status"))


@query("""WITH r AS (SELECT o_orderpriority AS job, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'partial' END AS status, o_orderdate AS started_at, CAST(floor(o_totalprice) AS BIGINT) AS rows_written FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01')
SELECT job, grouping(job) = 1 AS overall, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed, round(100.0 * count(*) FILTER (status = 'success') / count(*), 1) AS success_rate, max(started_at) AS last_run_at, CAST(sum(rows_written) AS BIGINT) AS total_rows_written FROM r GROUP BY ROLLUP (job)""")
def run_summary(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", summary.SUCCESS).when(F.col("o_orderstatus") == "O", summary.FAILED).otherwise(summary.PARTIAL)
    r = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("job"), status.alias("status"), F.col("o_orderdate").alias("started_at"), F.floor("o_totalprice").cast("bigint").alias("rows_written"))
    return rounded(summary.runs(r, F.expr("TIMESTAMP_NTZ '1998-06-01 00:00:00'"), ["rows_written"]), 1)


_LATEST = "l AS (SELECT * FROM (SELECT o_custkey AS asset, CAST(o_orderkey * 7 % 101 AS DOUBLE) AS overall_score, CAST(o_orderkey * 3 % 101 AS DOUBLE) AS completeness, CAST(o_orderkey * 5 % 101 AS DOUBLE) AS validity, o_orderstatus AS grade, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1)"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = lambda k: (F.col("o_orderkey") * k % 101).cast("double")
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset"), score(7).alias("overall_score"), score(3).alias("completeness"), score(5).alias("validity"), F.col("o_orderstatus").alias("grade"), "o_orderdate", "o_orderkey")
    return summary.latest_scores(d, [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query(f"WITH {_LATEST} SELECT grade, grouping(grade) = 1 AS overall, count(*) AS assets, round(avg(overall_score), 2) AS overall_score, round(avg(completeness), 2) AS completeness, round(avg(validity), 2) AS validity FROM l GROUP BY ROLLUP (grade)")
def quality_summary(spark, sf_dir):
    return summary.platform_quality(_latest(spark, sf_dir), ["completeness", "validity"])


@query(f"WITH {_LATEST} SELECT asset, grade, round(overall_score, 2) AS overall_score FROM l ORDER BY l.overall_score, asset LIMIT 5")
def worst_assets(spark, sf_dir):
    return rounded(summary.worst(_latest(spark, sf_dir)).select("asset", "grade", "overall_score"), 2)


@query("""WITH b AS (SELECT p_type AS "check", p_brand AS dimension, CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'warning' END AS status FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N')
SELECT "check", dimension, count(*) AS n, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'warning') AS n_warning FROM b GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 8""")
def failing_checks(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "N", "passed").otherwise("warning")
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return summary.top_failing(d.select(F.col("p_type").alias("check"), F.col("p_brand").alias("dimension"), status.alias("status")))


@query("SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def facets(spark, sf_dir):
    return summary.facets(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
