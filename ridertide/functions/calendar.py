"""Time expressions on a regular grid.

A grid step is a whole number: minutes since 1970-01-01 00:00 wall-clock, divided by the bucket size. Integer steps
keep window ordering, slicing and grouping cheap, and do not depend on the session time zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridertide.config import MINUTES_PER_DAY, SeriesConfig

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def minute_index(ts: Column) -> Column:
    day = F.unix_date(ts.cast("date")).cast("bigint")
    return day * MINUTES_PER_DAY + F.hour(ts) * 60 + F.minute(ts)


def step_of(ts: Column, bucket_minutes: int) -> Column:
    """Grid step that holds a timestamp."""
    return F.floor(minute_index(ts) / F.lit(bucket_minutes)).cast("bigint")


def time_of(step: Column, bucket_minutes: int) -> Column:
    """Start of a grid step as a zone-less timestamp."""
    minutes = (step * bucket_minutes).cast("int")
    return F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))


def op_minute(step: Column, cfg: SeriesConfig) -> Column:
    """Minutes since the epoch, shifted so that the operating day starts at midnight."""
    return step * cfg.bucket_minutes - cfg.day_start_hour * 60


def op_date(step: Column, cfg: SeriesConfig) -> Column:
    return F.date_from_unix_date(F.floor(op_minute(step, cfg) / F.lit(MINUTES_PER_DAY)).cast("int"))


def slot_in_day(step: Column, cfg: SeriesConfig) -> Column:
    """Position in the operating day: hours times buckets per hour, plus the bucket within the hour."""
    minute = F.pmod(op_minute(step, cfg), F.lit(MINUTES_PER_DAY))
    per_hour = 60 // cfg.bucket_minutes
    within = F.floor(F.pmod(minute, F.lit(60)) / F.lit(cfg.bucket_minutes))
    return (F.floor(minute / F.lit(60)) * per_hour + within).cast("int")


def cyclic(slot: Column, period: int) -> tuple[Column, Column]:
    angle = slot * F.lit(2 * math.pi) / F.lit(period)
    return F.sin(angle), F.cos(angle)


def calendar_columns(step: Column, cfg: SeriesConfig) -> dict[str, Column]:
    """Operating date, weekday (Monday is 0), slot and its cyclic form."""
    slot = slot_in_day(step, cfg)
    sin, cos = cyclic(slot, cfg.day_lag)
    date = op_date(step, cfg)
    return {
        "date": date,
        "day_of_week": F.weekday(date),
        "slot_in_day": slot,
        "hour_sin": sin,
        "hour_cos": cos,
    }
