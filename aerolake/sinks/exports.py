"""Exports: samples of a table as CSV or JSON lines, reports as flat tables, the catalog as JSON.

Files are written by Spark's writers. The byte order mark that spreadsheets want stands before the first name of the
header. Nested values become JSON, nulls empty cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.functions import standards as S
from aerolake.functions.scalars import cell
from aerolake.sources import query

# Rows of an export by default and at most.
CSV_ROWS, CSV_MOST, JSON_ROWS, JSON_MOST = 5000, 200_000, 2000, 50_000
BOM = "\ufeff"
# Columns of the report exports and their headings.
COMPLIANCE_HEADINGS = {"city_name": "城市", "city_id": "slug", "days": "统计天数", "good_days": "优良天", "exceed_days": "超标天", "good_percent": "优良天比例(%)", "target": "目标(%)", "target_met": "是否达标", "gap": "差距(百分点)", "mean": "日均AQI", "peak": "AQI峰值", "exceed_hours": "超标小时数", "obs_hours": "有效观测小时数", "exceed_hour_percent": "超标小时占比(%)"}
EPISODE_HEADINGS = {"place": "序号", "city_name": "城市", "start_time": "开始时间", "end_time": "结束时间", "duration": "持续小时", "exceed_hours": "超标小时", "peak": "峰值AQI", "peak_level": "峰值等级", "mean": "均值AQI", "primary_pollutant": "首要污染物", "wind_speed_avg": "平均风速(km/h)", "humidity_avg": "平均湿度(%)", "precipitation_sum": "累计降水(mm)", "stagnant_hours": "静稳小时", "severity": "严重度", "chronic": "持续性污染"}
YES, NO = "是", "否"


def _limited(n: int | None, default: int, most: int) -> int:
    n = default if n is None else n
    if not 1 <= n <= most:
        raise ValueError(f"between 1 and {most} rows can be exported")
    return n


def cells(df: DataFrame) -> DataFrame:
    """Every value as the text of a cell."""
    return df.select(*(cell(F.col(f"`{f.name}`"), f.dataType.simpleString()).alias(f.name) for f in df.schema.fields))


def csv(df: DataFrame, path: str, rows: int | None = None, bom: bool = True) -> DataFrame:
    """The newest rows in order of time as one CSV file in a folder; the rows written are returned."""
    out = cells(query.sample(df, _limited(rows, CSV_ROWS, CSV_MOST)))
    named = out.withColumnRenamed(out.columns[0], BOM + out.columns[0]) if bom else out
    named.coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("emptyValue", "").csv(path)  # of a limited number of rows
    return out


def json_lines(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """The newest rows in order of time as JSON lines, with nulls."""
    out = query.sample(df, _limited(rows, JSON_ROWS, JSON_MOST))
    out.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)  # of a limited number of rows
    return out


def dataset_document(asset: DataFrame, columns: DataFrame, rows: DataFrame, n: int | None = None) -> DataFrame:
    """One row ``document``: an asset's description, its dictionary in order and its newest rows, as JSON."""
    keep = {"ignoreNullFields": "false"}
    own = asset.select("asset_key", F.to_json(F.struct("*"), keep).alias("dataset"))
    fields = columns.groupBy("asset_key").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct("name", "type", "unit", "description").alias("c")))), lambda x: x["c"]), keep).alias("columns"))  # the columns of an asset
    some = query.sample(rows, _limited(n, JSON_ROWS, JSON_MOST))
    listed = some.agg(F.collect_list(F.to_json(F.struct("*"), keep)).alias("rows"), F.count("*").alias("row_count"))  # of a limited number of rows
    return own.join(fields, "asset_key", "left").crossJoin(listed).select("asset_key", "row_count", F.concat(F.lit('{"dataset":'), "dataset", F.lit(',"columns":'), F.coalesce("columns", F.lit("[]")), F.lit(',"row_count":'), F.col("row_count").cast("string"), F.lit(',"rows":['), F.array_join("rows", ","), F.lit("]}")).alias("document"))


def _headed(df: DataFrame, headings: dict[str, str], more: dict[str, str] | None = None) -> DataFrame:
    names = {c: h for c, h in (headings | (more or {})).items() if c in df.columns}
    flag = lambda c: F.when(F.col(c), YES).otherwise(NO) if dict(df.dtypes)[c] == "boolean" else F.col(c)
    return df.select(*(flag(c).alias(h) for c, h in names.items()))


def compliance_table(report: DataFrame) -> DataFrame:
    """The compliance report by city as a flat table with headings, the best share of good days first."""
    d = report.where("entity IS NOT NULL").withColumn("city_id", F.col("entity"))
    d = d if "city_name" in d.columns else d.withColumn("city_name", F.col("city_id"))
    return _headed(d.orderBy(F.desc("good_percent"), "city_id"), COMPLIANCE_HEADINGS, {f"days_{x}": f"{x}天数" for x in S.LEVELS})


def episode_table(found: DataFrame) -> DataFrame:
    """Ranked episodes as a flat table with headings."""
    d = found if "city_name" in found.columns else found.withColumn("city_name", F.col("city_id"))
    return _headed(d.orderBy("place"), EPISODE_HEADINGS)


def distribution_table(stats: DataFrame) -> DataFrame:
    """Descriptions of metrics as a flat table: all entities first, then by entity."""
    return stats.drop("outliers").orderBy("metric", F.col("entity").asc_nulls_first())


def catalog_document(assets: DataFrame, columns: DataFrame) -> DataFrame:
    """asset_key and document: each asset with its dictionary as JSON."""
    fields = columns.groupBy("asset_key").agg(F.array_sort(F.collect_list(F.struct("place", "name", "type", "unit", "description"))).alias("columns"))  # the columns of an asset
    return assets.join(fields, "asset_key", "left").select("asset_key", F.to_json(F.struct(*assets.columns, "columns"), {"ignoreNullFields": "false"}).alias("document"))
