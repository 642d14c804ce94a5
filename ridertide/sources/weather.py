"""Hourly weather: one city-level row per hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted time columns, in order of preference, and the covariates.
TIME_COLUMNS = ("time", "timestamp", "datetime", "weather_time")
COVARIATES = (
    "temperature_2m",
    "relative_humidity_2m",
    "precipitation",
    "rain",
    "snowfall",
    "snow_depth",
    "weather_code",
    "wind_speed_10m",
)
WEATHER_FEATURES = tuple(f"weather_{c}" for c in COVARIATES)


def read_weather(spark: SparkSession, path: str) -> DataFrame | None:
    """Hourly weather file. Gives None when it holds none of the covariates."""
    raw = spark.read.option("header", True).csv(path)
    in_file = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )
    return hourly_weather(raw.withColumn("file_order", in_file), F.col("file_order"))


def hourly_weather(raw: DataFrame, order: Column) -> DataFrame | None:
    """Weather rows keyed by hour; of several rows for one hour the last by ``order`` stays.

    Keeping the last row is an aggregate, so each task sends one row per hour however many it read.
    """
    time_col = next((c for c in TIME_COLUMNS if c in raw.columns), None)
    if time_col is None:
        raise ValueError(f"weather needs one of the columns {TIME_COLUMNS}, got {raw.columns}")
    found = {}
    for source, target in zip(COVARIATES, WEATHER_FEATURES):
        if target in raw.columns:
            found[target] = F.col(target)
        elif source in raw.columns:
            found[target] = F.col(source).try_cast("double")
    if not found:
        return None
    hour = F.date_trunc("hour", F.col(time_col).try_cast("timestamp_ntz")).cast("timestamp_ntz")
    kept = raw.select(hour.alias("weather_hour"), order.alias("row_order"), *[c.alias(n) for n, c in found.items()])
    kept = kept.filter(F.col("weather_hour").isNotNull())
    last = F.max_by(F.struct(*found), F.col("row_order")).alias("last")
    return kept.groupBy("weather_hour").agg(last).select("weather_hour", "last.*")


def require_times(weather: DataFrame) -> DataFrame:
    """Stop when no timestamp could be read."""
    if weather.isEmpty():
        raise ValueError("no weather timestamp could be read")
    return weather
