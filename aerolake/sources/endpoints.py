"""The weather service: requests as rows, a data source that answers them, and the contract of an answer.

The build environment has no network, so ``Answers`` reads answers from a folder of JSON files, one for each request
key; on a cluster the same reader serves whatever mirror of the service a folder holds. Requests are dealt to
partitions by city, so a lost executor costs its own cities.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The variables that are asked for, by endpoint.
VARIABLES = {
    "forecast_hourly": "temperature_2m relative_humidity_2m dew_point_2m apparent_temperature precipitation rain snowfall precipitation_probability weather_code cloud_cover pressure_msl surface_pressure wind_speed_10m wind_direction_10m wind_gusts_10m is_day visibility uv_index".split(),
    "forecast_daily": "weather_code temperature_2m_max temperature_2m_min apparent_temperature_max apparent_temperature_min precipitation_sum rain_sum snowfall_sum precipitation_hours precipitation_probability_max wind_speed_10m_max wind_gusts_10m_max wind_direction_10m_dominant shortwave_radiation_sum et0_fao_evapotranspiration uv_index_max sunshine_duration daylight_duration".split(),
    "archive": "temperature_2m relative_humidity_2m dew_point_2m apparent_temperature precipitation rain snowfall snow_depth weather_code cloud_cover pressure_msl surface_pressure wind_speed_10m wind_direction_10m wind_gusts_10m shortwave_radiation et0_fao_evapotranspiration".split(),
    "air_quality": "pm2_5 pm10 carbon_monoxide nitrogen_dioxide sulphur_dioxide ozone ammonia dust aerosol_optical_depth uv_index uv_index_clear_sky european_aqi european_aqi_pm2_5 european_aqi_pm10 european_aqi_nitrogen_dioxide european_aqi_ozone european_aqi_sulphur_dioxide us_aqi us_aqi_pm2_5 us_aqi_pm10 us_aqi_nitrogen_dioxide us_aqi_ozone us_aqi_sulphur_dioxide us_aqi_carbon_monoxide alder_pollen birch_pollen grass_pollen mugwort_pollen olive_pollen ragweed_pollen".split(),
}
# Paths, sections of an answer, and limits of the service in days.
PATHS = {"geocoding": "/v1/search", "forecast_hourly": "/v1/forecast", "forecast_daily": "/v1/forecast", "archive": "/v1/archive", "air_quality": "/v1/air-quality"}
SECTION = {"forecast_daily": "daily"}
ARCHIVE_LAG, AIR_MOST_PAST, AIR_MOST_AHEAD = 5, 92, 7


def requests(cities: DataFrame, endpoint: str, today, past_days: int = 2, ahead_days: int = 7, start=None, end=None) -> DataFrame:
    """city_id, endpoint, path and params (a map) of one request for each city (city_id, name, latitude, longitude,
    timezone). Archives end ARCHIVE_LAG days before today; if nothing is left to ask for, there is no request."""
    text = lambda c: c.cast("string")
    params: dict = {"latitude": text(F.col("latitude")), "longitude": text(F.col("longitude")), "timezone": F.coalesce("timezone", F.lit("UTC"))}
    if endpoint == "geocoding":
        params = {"name": F.col("name"), "count": F.lit("5"), "language": F.lit("zh"), "format": F.lit("json")}
    elif endpoint == "archive":
        last = F.least(F.lit(str(end)).cast("date"), F.date_sub(F.lit(str(today)).cast("date"), ARCHIVE_LAG))
        cities = cities.where(last >= F.lit(str(start)).cast("date"))
        params |= {"start_date": F.lit(str(start)), "end_date": text(last)}
    elif endpoint == "air_quality":
        params |= {"past_days": F.lit(str(max(0, min(past_days, AIR_MOST_PAST)))), "forecast_days": F.lit(str(min(ahead_days, AIR_MOST_AHEAD)))}
    else:
        params |= {"past_days": F.lit(str(past_days)), "forecast_days": F.lit(str(ahead_days)), "wind_speed_unit": F.lit("kmh")}
    if endpoint in VARIABLES:
        params[SECTION.get(endpoint, "hourly")] = F.lit(",".join(VARIABLES[endpoint]))
    return cities.select("city_id", F.lit(endpoint).alias("endpoint"), F.lit(PATHS[endpoint]).alias("path"), F.create_map(*[x for k, v in params.items() for x in (F.lit(k), v)]).alias("params"))


def missing(answers: DataFrame, endpoint: str) -> DataFrame:
    """city_id, returned and missing variables of each answer (city_id, body); ``broken`` if it has none of them."""
    asked = F.lit(VARIABLES[endpoint])
    section = SECTION.get(endpoint, "hourly")
    keys = F.coalesce(F.json_object_keys(F.get_json_object("body", f"$.{section}")), F.array().cast("array<string>"))
    d = answers.select("city_id", F.array_intersect(asked, keys).alias("returned"), F.array_except(asked, keys).alias("missing"))
    return d.withColumn("broken", F.size("returned") == 0)


def places(answers: DataFrame) -> DataFrame:
    """Candidates of geocoding answers (city_id, body): name, position, country, zone, population, in order."""
    kind = "struct<results: array<struct<name: string, latitude: double, longitude: double, elevation: double, country: string, country_code: string, admin1: string, timezone: string, population: bigint, feature_code: string>>>"
    return answers.select("city_id", F.posexplode(F.from_json("body", kind)["results"]).alias("place", "c")).select("city_id", "place", "c.*")


class _City(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.endpoint = options["path"], options["endpoint"]
        self.cities = [c for c in options.get("cities", "").split(",") if c]

    def partitions(self) -> list[InputPartition]:
        return [_City([c]) for c in self.cities] or [_City([])]

    def read(self, partition: _City) -> Iterator[tuple]:
        for city in partition.keys:
            try:
                with open(os.path.join(self.folder, self.endpoint, f"{city}.json"), encoding="utf-8") as f:
                    body = f.read()
                reason = json.loads(body).get("reason") if '"error"' in body else None
                yield city, None if reason else body, reason
            except (OSError, ValueError) as e:
                yield city, None, f"{type(e).__name__}: {e}"


class Answers(DataSource):
    """Format ``weather_answers``: options path (a folder that all executors share), endpoint and cities
    (separated by commas); rows of city_id, body and error."""

    @classmethod
    def name(cls) -> str:
        return "weather_answers"

    def schema(self) -> str:
        return "city_id string, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def answers(spark: SparkSession, folder: str, endpoint: str, cities: list[str]) -> DataFrame:
    spark.dataSource.register(Answers)
    return spark.read.format("weather_answers").option("path", folder).option("endpoint", endpoint).option("cities", ",".join(cities)).load()
