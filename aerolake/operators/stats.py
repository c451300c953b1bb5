"""Distributions, correlations, regressions and outliers. ``by`` lists the grouping columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake import rounds
from aerolake.functions import standards as S
from aerolake.operators import places

PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, mean, std (0 for one row), min, max, range, five percentiles, iqr and cv. The percentiles of groups too large for
    one buffer are selected (``places.quantiles``)."""
    v = F.col(value)
    d = df.where(v.isNotNull())
    some = [F.count("*").alias("count"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")]
    if places.largest(d, by) <= places.HOT:
        d = d.groupBy(*by).agg(*some, F.percentile(v, F.lit(PERCENTILES)).alias("p"))
    else:
        d = places.on(d.groupBy(*by).agg(*some), places.percentiles(d, value, by, PERCENTILES).withColumnRenamed("q", "p"), by)
    names = [f"p{int(100 * p)}" for p in PERCENTILES]
    d = d.select(*by, "count", "mean", "std", "min", "max", *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)))
    return d.withColumns({"range": F.col("max") - F.col("min"), "iqr": F.col("p75") - F.col("p25"), "cv": F.try_divide("std", F.abs("mean"))})


def _fences(df: DataFrame, value: str, by: list[str], factor: float) -> DataFrame:
    q = places.percentiles(df, value, by, [0.25, 0.5, 0.75])
    q = q.select(*by, F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"))
    return q.withColumns({"low_fence": F.col("q1") - factor * (F.col("q3") - F.col("q1")), "high_fence": F.col("q3") + factor * (F.col("q3") - F.col("q1"))})


def boxplot(df: DataFrame, value: str, by: list[str], factor: float = 1.5, most: int = 50) -> DataFrame:
    """Quartiles, fences, whiskers inside the fences, number of outliers and the ``most`` least; of the
    outliers each task of a group keeps the ``most`` least only."""
    v, inside = F.col(value), F.col(value).between(F.col("low_fence"), F.col("high_fence"))
    fences = _fences(df, value, by, factor)
    d = df.where(v.isNotNull()).join(fences, by)
    keys = [*by, "q1", "median", "q3", "low_fence", "high_fence"]
    out = d.groupBy(*keys).agg(F.min(F.when(inside, v)).alias("low_whisker"), F.max(F.when(inside, v)).alias("high_whisker"), F.count_if(~inside).alias("n_outliers"))
    part = d.where(~inside).withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(64)))
    few = least_of(least_of(part, [*by, "_part"], [v.asc()], most), by, [v.asc()], most)
    lists = few.groupBy(*by).agg(F.array_sort(F.collect_list(v)).alias("outliers"))  # of ``most`` at most
    return out.join(lists, by, "left").withColumn("outliers", F.coalesce("outliers", F.array().cast("array<double>")))


def least_of(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n a group in every task before it shuffles."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def histogram(df: DataFrame, value: str, by: list[str], bins: int = 20) -> DataFrame:
    """Equal-width bins, the last one closed, empty ones kept; constant values get a width of one."""
    v = F.col(value)
    d = df.where(v.isNotNull())
    lo, hi = F.min(v), F.max(v)
    r = d.groupBy(*by).agg(F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"), F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"), F.count("*").alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    counted = d.join(r, by).groupBy(*by, F.least(F.floor((v - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = every.join(counted, [*by, "bin"], "left")
    return out.select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"), (F.col("lo") + (F.col("bin") + 1) * width).alias("right_edge"), F.coalesce("n", F.lit(0)).alias("n"), (100.0 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("percent"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; null under 3 rows or for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.when(F.count(x) >= 3, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def average_ranks(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Ranks with ties averaged, one column ``rank_<c>`` for each. In groups of up to ``places.HOT`` rows the counts of the distinct
    values are put in order by group. Beyond, they are dealt by ranges, and each begins after what the ranges before hold of
    its group, so that neither a value's rows nor a group's values need meet; few distinct values (their bytes are
    counted) are broadcast to the rows."""
    hot, out = places.largest(df, by) > places.HOT, df
    for c in columns:
        counts = df.groupBy(*by, c).agg(F.count("*").alias("_n"))
        if hot:
            ranks = places.summed(counts, by, [c], F.col("_n"), "_before")
        else:
            before = Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
            ranks = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        ranks = ranks.select(*by, c, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(f"rank_{c}"))
        out = places.on(out, rounds.small(rounds.cut(ranks)) if hot else ranks, [*by, c])
    return out


def pair(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """samples, Pearson, Spearman, and slope, intercept and r2 of y on x."""
    d = average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), [x, y], by)
    r2 = F.when(F.var_pop(y) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.regr_r2(y, x))))
    out = d.groupBy(*by).agg(F.count("*").alias("samples"), pearson(F.col(x), F.col(y)).alias("pearson"), pearson(F.col(f"rank_{x}"), F.col(f"rank_{y}")).alias("spearman"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), r2.alias("r2"))
    return out


def correlation_pairs(df: DataFrame, columns: list[str], top: int = 12) -> DataFrame:
    """The ``top`` pairs of columns by absolute correlation, from one aggregate."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*(pearson(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    out = row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")
    return out.where("r IS NOT NULL").orderBy(F.abs("r").desc(), "left", "right").limit(top)


def binned_curve(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Mean, median and count of y in equal-width bins of x; nothing under 2 * bins rows."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    r = d.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n"))
    d = d.join(F.broadcast(r)).where(F.col("n") >= 2 * bins)  # r is one row
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return d.groupBy(place.cast("int").alias("bin")).agg(F.avg(y).alias("mean"), F.percentile(y, F.lit(0.5)).alias("median"), F.count("*").alias("n"))


def z_scores(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """df with ``z`` (sample deviation; 0 if that is 0); mean and deviation are an aggregate joined back."""
    d = df.where(F.col(value).isNotNull())
    stats = d.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    d = d.join(stats, by)
    return d.withColumn("z", F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def robust_z(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """df with ``z`` from the median and the median absolute deviation."""
    d = df.where(F.col(value).isNotNull())
    med = places.percentiles(d, value, by, [0.5]).select(*by, F.get("q", 0).alias("med"))
    d = d.join(med, by).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    mad = places.percentiles(d, "dev", by, [0.5]).select(*by, F.get("q", 0).alias("mad"))
    d = d.join(mad, by)
    return d.withColumn("z", F.when(F.col("mad") > 0, 0.6745 * (F.col(value) - F.col("med")) / F.col("mad")).otherwise(0.0)).drop("med", "dev", "mad")


def outliers(df: DataFrame, value: str, by: list[str], threshold: float = 3.0, per_group: int = 60, total: int | None = None) -> DataFrame:
    """Rows with |z| over the threshold, at most ``per_group`` of each group by |z|, and of those at most
    ``total`` by |z|."""
    rest = [c for c in df.columns if c not in by]
    w = Window.partitionBy(*by).orderBy(F.abs("z").desc(), *rest)
    out = z_scores(df, value, by).where(F.abs("z") > threshold).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_group)
    return out.orderBy(F.abs("z").desc(), *by, *rest).limit(total) if total else out


def outlier_report(df: DataFrame, value: str, by: list[str], threshold: float = 3.0, fewest: int = 3) -> DataFrame:
    """samples, flagged and their share, mean, deviation and largest |z| of each group of ``fewest`` rows."""
    z = z_scores(df, value, by)
    d = z.groupBy(*by).agg(F.count("*").alias("samples"), F.count_if(F.abs("z") > threshold).alias("flagged"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.max(F.abs("z")).alias("max_z"))
    return d.where(F.col("samples") >= fewest).withColumn("flagged_percent", F.round(100.0 * F.col("flagged") / F.col("samples"), 3))


def fence_outliers(df: DataFrame, value: str, by: list[str], factor: float = 1.5) -> DataFrame:
    """Number of rows and of those outside the fences, by group."""
    d = df.where(F.col(value).isNotNull()).join(_fences(df, value, by, factor), by)
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.count_if((F.col(value) < F.col("low_fence")) | (F.col(value) > F.col("high_fence"))).alias("n_outliers"))


def thinned(df: DataFrame, by: list[str], order: list[str], most: int = 1500, ranges: int = 64) -> DataFrame:
    """Every (n // most)-th row of a group in order. Places come from counts by group and slice of the first
    order column (equal widths between its extremes), so that no task has to put a whole group in order."""
    first = F.unix_micros(F.col(order[0]).cast("timestamp")) if dict(df.dtypes)[order[0]].startswith(("timestamp", "date")) else F.col(order[0]).cast("double")
    d = df.withColumn("_v", first)
    ends = d.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    slice_ = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * ranges), F.lit(ranges - 1))).otherwise(0).cast("int")
    d = d.join(ends, by).withColumn("_slice", F.coalesce(slice_, F.lit(-1)))
    sizes = d.groupBy(*by, "_slice").agg(F.count("*").alias("_s"))
    before = sizes.select(*by, "_slice", F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    d = d.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*order))).join(before, [*by, "_slice"])
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return d.where((F.col("_before") + F.col("_in") - 1) % step == 0).drop("_v", "_lo", "_hi", "_n", "_slice", "_in", "_before")


def column_profile(df: DataFrame, columns: list[str], ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row for each numeric column: rows, nulls, distinct, min, max, mean, median, std, out of range. Beyond
    ``places.HOT`` rows the medians are selected and the distinct values counted by shuffles of their own."""
    if df.count() > places.HOT:
        v = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"), F.lit((ranges or {}).get(c, (None, None))[0]).cast("double").alias("lo"), F.lit((ranges or {}).get(c, (None, None))[1]).cast("double").alias("hi")) for c in columns))))
        sums = v.groupBy("column").agg(F.count("*").alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count_if((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))).alias("out_of_range"))
        found = v.where("v IS NOT NULL").select("column", "v").distinct().groupBy("column").agg(F.count("*").alias("distinct_values"))
        half = places.percentiles(v, "v", ["column"], [0.5]).select("column", F.get("q", 0).alias("median"))
        d = sums.join(found, "column", "left").fillna(0, ["distinct_values"]).join(half, "column", "left")
        return d.select("column", "rows", "nulls", "distinct_values", "min", "max", "mean", "median", "std", "out_of_range")
    aggs = []
    for i, c in enumerate(columns):
        lo, hi = (ranges or {}).get(c, (float("-inf"), float("inf")))
        v = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(v.isNull()).alias("nulls"), F.count_distinct(v).alias("distinct_values"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_samp(v).alias("std"), F.count_if((v < lo) | (v > hi)).alias("out_of_range")).alias(f"c{i}"))
    return df.agg(*aggs).select(F.inline(F.array(*(F.col(f"c{i}") for i in range(len(columns))))))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns centred and divided by the population deviation (1 if that is 0); one aggregate row
    is broadcast."""
    stats = df.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"s_{c}") for c in columns))
    out = df.join(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"s_{c}.m")) / F.when(F.col(f"s_{c}.s") > 0, F.col(f"s_{c}.s")).otherwise(1.0) for c in columns}).drop(*(f"s_{c}" for c in columns))


def top_values(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """column, value and count of the n most frequent values of each column; ties go by value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("count"))
    return least_of(counts, ["column"], [F.desc("count"), F.col("value")], n)


def long(df: DataFrame, metrics: list[str], keep: list[str]) -> DataFrame:
    """One row for each row and metric: keep, metric, value."""
    return df.select(*keep, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))).where("value IS NOT NULL AND NOT isnan(value)")


def distribution(df: DataFrame, metrics: list[str], entity: str, bins: int | None = None) -> DataFrame:
    """Description and boxplot of each metric over all entities (entity null) and by entity, in one job: a row
    counts twice, for its entity and for all. With ``bins`` the histogram as well: an array in the order of the bins."""
    d = long(df, metrics, [entity]).select("metric", F.explode(F.array(F.col(entity).cast("string"), F.lit(None).cast("string"))).alias("entity"), "value")
    d = d.withColumn("entity", F.coalesce("entity", F.lit("")))
    out = describe(d, "value", ["metric", "entity"]).join(boxplot(d, "value", ["metric", "entity"]).drop("median"), ["metric", "entity"])
    if bins:
        bars = histogram(d, "value", ["metric", "entity"], bins)
        out = out.join(bars.groupBy("metric", "entity").agg(F.array_sort(F.collect_list(F.struct("bin", "left_edge", "right_edge", "n", "percent"))).alias("histogram")), ["metric", "entity"])  # bins of them
    return out.withColumn("entity", F.when(F.col("entity") != "", F.col("entity")))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """left, right, Pearson and Spearman of every pair of columns, over the rows that have all of them."""
    d = df.dropna(subset=columns).select(*columns)
    ranks = average_ranks(d.withColumn("_all", F.lit(0)), columns, ["_all"])
    pairs = list(combinations(columns, 2))
    aggs = [a for i, (x, y) in enumerate(pairs) for a in (pearson(F.col(x), F.col(y)).alias(f"p{i}"), pearson(F.col(f"rank_{x}"), F.col(f"rank_{y}")).alias(f"s{i}"))]
    rows = F.array(*(F.struct(F.lit(x).alias("left"), F.lit(y).alias("right"), F.col(f"p{i}").alias("pearson"), F.col(f"s{i}").alias("spearman")) for i, (x, y) in enumerate(pairs)))
    return ranks.agg(*aggs).select(F.inline(rows))


def relationship(df: DataFrame, x: str, y: str, entity: str) -> DataFrame:
    """Correlations and regression of y on x over all rows (entity null) and by entity, with strengths in words."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.explode(F.array(F.col(entity).cast("string"), F.lit(None).cast("string"))).alias("entity"), x, y)
    out = pair(d.withColumn("entity", F.coalesce("entity", F.lit(""))), x, y, ["entity"])
    return out.withColumns({"entity": F.when(F.col("entity") != "", F.col("entity")), "pearson_label": S.correlation_label(F.col("pearson")), "spearman_label": S.correlation_label(F.col("spearman"))})


def relationship_report(df: DataFrame, x: str, y: str, entity: str, bins: int = 10, points: int = 600, labels: tuple[str, str] | None = None) -> DataFrame:
    """``relationship`` with its sentence and, over all rows (entity null), the binned curve of y on x and about ``points``
    of the pairs, every n-th by x and y."""
    d = relationship(df, x, y, entity).withColumn("said", interpretation(F.col("pearson"), F.col("spearman"), *(labels or (x, y))))
    curve = binned_curve(df, x, y, bins).agg(F.array_sort(F.collect_list(F.struct("bin", "mean", "median", "n"))).alias("curve"))
    some = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.lit(0).alias("_every"), x, y)
    drawn = thinned(some, ["_every"], [x, y], points).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("points"))  # under 2 * points
    both = curve.crossJoin(drawn)  # one row each
    whole = d.where("entity IS NULL").crossJoin(both)
    return whole.unionByName(d.where("entity IS NOT NULL").withColumns({"curve": F.lit(None).cast(both.schema["curve"].dataType), "points": F.lit(None).cast(both.schema["points"].dataType)}))


def interpretation(pearson_r: Column, spearman_r: Column, x_label: str, y_label: str) -> Column:
    """A few words on a relation: how strong it is on a line and by ranks, and which of the two fits better."""
    two = lambda r: F.format_number(r, 2)
    way = F.element_at(F.create_map(F.lit(1.0), F.lit("rises"), F.lit(-1.0), F.lit("falls"), F.lit(0.0), F.lit("stays")), F.signum(pearson_r))
    share = F.format_number(100 * pearson_r * pearson_r, 0)
    line = F.concat(F.lit(f"{y_label} "), way, F.lit(f" with {x_label}: r = "), two(pearson_r), F.lit(", so a line accounts for "), share, F.lit(" % of its variance"))
    gain = F.greatest(F.lit(0.0), spearman_r * spearman_r - pearson_r * pearson_r)
    ranks = F.concat(F.lit("; by ranks "), two(spearman_r), F.lit(", "), F.format_number(100 * gain, 0), F.lit(" points more"))
    return F.coalesce(F.concat(line, F.coalesce(ranks, F.lit(""))), F.lit(f"too few pairs of {x_label} and {y_label}, or one of them is constant"))


def imputed(features: DataFrame, columns: list[str]) -> DataFrame:
    """Missing features become the mean of their column, or 0 if that has no value; rows without any go."""
    d = features.dropna(how="all", subset=columns)
    means = d.agg(*(F.avg(c).alias(f"_{c}") for c in columns))
    return d.join(F.broadcast(means)).withColumns({c: F.coalesce(c, f"_{c}", F.lit(0.0)) for c in columns}).drop(*(f"_{c}" for c in columns))  # one row
