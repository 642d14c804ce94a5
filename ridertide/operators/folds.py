"""Day folds in time order.

The first four operating days that pass the weekday filter are d1 to d4. Fold ``tune`` trains on d1, d2 and is
evaluated on d3; fold ``full`` trains on d1 to d3 and is evaluated on d4. A fold table is one DataFrame with the
columns ``fold`` and ``role``.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridertide.config import MINUTES_PER_DAY, NetworkConfig, SeriesConfig, StationConfig
from ridertide.functions.calendar import op_date
from ridertide.operators.densify import series_bounds

FOLD_DAYS = 4
TUNE, FULL = "tune", "full"
TRAIN, EVAL = "train", "eval"


def fold_dates(counts: DataFrame, cfg: SeriesConfig, keys: tuple[str, ...] = ("station_key",)) -> list[datetime.date]:
    """The first four operating dates on wanted weekdays that any dense series covers.

    A dense series covers every day between its first and last bucket, and the four smallest dates of a union are
    among the four smallest of each part. So four dates per series, taken from its bounds, are enough.
    """
    bounds = series_bounds(counts, keys)
    first, last = op_date(F.col("lo"), cfg), op_date(F.col("hi"), cfg)
    days = F.sequence(first, F.least(last, F.date_add(first, 7 * FOLD_DAYS - 1)))
    wanted = F.filter(days, lambda d: F.weekday(d).isin(*cfg.weekdays))
    found = bounds.select(F.explode(F.slice(wanted, 1, FOLD_DAYS)).alias("date")).distinct()
    dates = [r[0] for r in found.orderBy("date").limit(FOLD_DAYS).collect()]
    if len(dates) < FOLD_DAYS:
        raise ValueError(f"need at least {FOLD_DAYS} operating dates, got {len(dates)}: {dates}")
    return dates


def fold_range(dates: list[datetime.date], cfg: NetworkConfig | StationConfig) -> tuple[int, int]:
    """Steps that the fold days and their lags and targets touch; everything else can be pruned at the scan."""
    epoch = datetime.date(1970, 1, 1)

    def first_step(day: datetime.date) -> int:
        return ((day - epoch).days * MINUTES_PER_DAY + cfg.day_start_hour * 60) // cfg.bucket_minutes

    stop = first_step(dates[-1] + datetime.timedelta(days=1)) + cfg.horizon_steps
    return first_step(dates[0]) - cfg.lookback, stop


def day_folds(frame: DataFrame, dates: list[datetime.date], cfg: SeriesConfig) -> DataFrame:
    """Rows of the four days, once per fold they belong to."""
    d1, d2, d3, d4 = [F.lit(d) for d in dates]
    day = F.col("date")

    def part(fold: str, role: str):
        return F.struct(F.lit(fold).alias("fold"), F.lit(role).alias("role"))

    early = F.array(part(TUNE, TRAIN), part(FULL, TRAIN))
    third = F.array(part(TUNE, EVAL), part(FULL, TRAIN))
    parts = F.when(day.isin(d1, d2), early).when(day == d3, third).otherwise(F.array(part(FULL, EVAL)))
    kept = frame.filter(day.isin(d1, d2, d3, d4))
    return kept.withColumn("part", F.explode(parts)).select("*", "part.*").drop("part")


def clip_per_day(folds: DataFrame, cfg: SeriesConfig, keys: tuple[str, ...] = ("station_key",)) -> DataFrame:
    """Drop the last horizon of each (station, day), whose targets reach into the next day."""
    w = Window.partitionBy("fold", "role", *keys, "date")
    return _clip(folds, w, cfg)


def clip_per_segment(folds: DataFrame, cfg: SeriesConfig) -> DataFrame:
    """Drop the last horizon of each segment as a whole; a segment is at most three days of one series."""
    return _clip(folds, Window.partitionBy("fold", "role"), cfg)


def _clip(folds: DataFrame, w, cfg: SeriesConfig) -> DataFrame:
    last = F.max("step").over(w)
    return folds.withColumn("last_step", last).filter(F.col("step") <= F.col("last_step") - cfg.horizon_steps).drop("last_step")


def split_profile(folds: DataFrame, time_col: str, station: str | None = "station_key") -> DataFrame:
    """Rows, stations and time span per fold and role."""
    columns = [F.count(F.lit(1)).alias("rows")]
    if station:
        columns.append(F.count_distinct(station).alias("stations"))
    return folds.groupBy("fold", "role").agg(
        *columns, F.min(time_col).alias("first_bucket"), F.max(time_col).alias("last_bucket")
    )
