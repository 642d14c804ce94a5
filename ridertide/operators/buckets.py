"""Event counts per station and time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridertide.config import SeriesConfig
from ridertide.functions.calendar import step_of, time_of
from ridertide.functions.text import contains_text
from ridertide.operators.stations import STATION_NAMES


def station_counts(events: DataFrame, places: DataFrame, cfg: SeriesConfig) -> DataFrame:
    """Counts per (station_key, step).

    Events are counted per (place, step) before the join: each task folds its own rows first, so a place with a
    third of all taps sends no more than one row per step, and only counts meet the place map. The join therefore
    needs no broadcast hint; the optimizer broadcasts the map if it is small and shuffles counts otherwise.
    """
    per_place = events.groupBy("PLACE_ID", _bucket_start(cfg)).agg(F.count(F.lit(1)).alias("n"))
    mapped = per_place.join(places.select("PLACE_ID", "station_key"), "PLACE_ID")
    per_station = mapped.groupBy("station_key", "bucket").agg(F.sum("n").cast("double").alias("count"))
    return per_station.select("station_key", _bucket_step(cfg), "count")


def series_counts(events: DataFrame, cfg: SeriesConfig) -> DataFrame:
    """Counts per step for one series."""
    counted = events.groupBy(_bucket_start(cfg)).agg(F.count(F.lit(1)).cast("double").alias("count"))
    return counted.select(_bucket_step(cfg), "count")


def rolled_up(counts: DataFrame, minutes: int, cfg: SeriesConfig) -> DataFrame:
    """Counts of one series at ``minutes`` summed to the settings' coarser buckets."""
    if cfg.bucket_minutes % minutes:
        raise ValueError(f"{minutes}-minute counts don't add up to {cfg.bucket_minutes} minutes")
    step = F.floor(F.col("step") / F.lit(cfg.bucket_minutes // minutes)).cast("bigint").alias("step")
    return counts.groupBy(step).agg(F.sum("count").alias("count"))


def _bucket_start(cfg: SeriesConfig) -> Column:
    """Bucket of an event: plain arithmetic on the stored value. Calendar fields are read after counting."""
    return F.window("TRAN_DATE", f"{cfg.bucket_minutes} minutes")["start"].alias("bucket")


def _bucket_step(cfg: SeriesConfig) -> Column:
    return step_of(F.col("bucket"), cfg.bucket_minutes).alias("step")


def bucket_table(counts: DataFrame, stations: DataFrame, cfg: SeriesConfig) -> DataFrame:
    """Counts with station names and bucket start, as stored on disk."""
    names = [c for c in (*STATION_NAMES, "station_label") if c in stations.columns]
    named = counts.join(stations.select("station_key", *names), "station_key")
    return named.select(
        "station_key", *names, time_of(F.col("step"), cfg.bucket_minutes).alias(cfg.time_col), "count"
    )


def counts_of(buckets: DataFrame, cfg: SeriesConfig) -> DataFrame:
    """A stored bucket table back as (station_key, step, count); rows without a time are dropped."""
    timed = buckets.filter(F.col(cfg.time_col).isNotNull())
    step = step_of(F.col(cfg.time_col), cfg.bucket_minutes).alias("step")
    return timed.select("station_key", step, F.col("count").cast("double").alias("count"))


def require_counts(counts: DataFrame) -> DataFrame:
    """Stop when no event matched the places."""
    if counts.isEmpty():
        raise ValueError("no event matched the selected places")
    return counts


def line_flow(buckets: DataFrame, stations: DataFrame, line: str) -> DataFrame:
    """Buckets of the stations on one line, with the short station name."""
    on_line = stations.filter(contains_text(F.col("LN_NAME_SHORT"), line))
    return buckets.join(on_line.select("station_key", F.col("ST_NAME_SHORT").alias("station_name")), "station_key")


def bucket_profile(buckets: DataFrame, time_col: str) -> DataFrame:
    """Rows, stations and time span of a bucket table."""
    return buckets.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("station_key").alias("stations"),
        F.min(time_col).alias("first_bucket"),
        F.max(time_col).alias("last_bucket"),
    )
