"""Supervised feature frames: target, lags, rolling statistics, calendar, slopes, codes, weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ridertide.config import NetworkConfig, SeriesConfig, StationConfig
from ridertide.functions.calendar import calendar_columns, time_of
from ridertide.functions.numeric import ratio, to_long
from ridertide.operators.densify import own_rows, series_bounds, slice_window, sliced_series
from ridertide.operators.ranking import add_codes
from ridertide.operators.stations import STATION_NAMES, STRUCTURE_COLUMNS

SERIES_KEY = ("station_key",)


def with_running(sliced: DataFrame, w: WindowSpec) -> DataFrame:
    """Running totals inside each slice: ``upto`` with the current row, ``before`` and ``before_sq`` without it.

    Every sum over a frame is then the difference of two totals, at a cost that does not depend on the frame length.
    Counts are whole numbers, so the differences are exact.
    """
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    count = F.col("count")
    totals = sliced.select("*", F.sum(count).over(rows).alias("upto"), F.sum(count * count).over(rows).alias("upto_sq"))
    return totals.withColumns({"before": F.col("upto") - count, "before_sq": F.col("upto_sq") - count * count})


RUNNING = ("upto", "upto_sq", "before", "before_sq")


def horizon_target(w: WindowSpec, horizon: int) -> Column:
    """Sum of the next ``horizon`` counts; NULL unless all of them exist."""
    return F.lead("upto", horizon).over(w) - F.col("upto")


def daylag_target(w: WindowSpec, horizon: int, day: int) -> Column:
    """The horizon target one day earlier, taken from the totals, so it needs no window of its own."""
    return F.lag("upto", day - horizon).over(w) - F.lag("upto", day).over(w)


def lag_columns(w: WindowSpec, lags) -> dict[str, Column]:
    return {f"lag_{n}": F.lag("count", n).over(w) for n in lags}


def _last(column: str, n: int, w: WindowSpec) -> Column:
    """Sum of the previous ``n`` rows, the current one left out; NULL unless all of them exist."""
    return F.col(column) - F.lag(column, n).over(w)


def rolling_columns(w: WindowSpec, sizes) -> dict[str, Column]:
    """Sum and mean of the previous rows."""
    out = {}
    for n in sizes:
        total = _last("before", n, w)
        out[f"roll_sum_{n}"] = total
        out[f"roll_mean_{n}"] = total / F.lit(float(n))
    return out


def volatility_columns(w: WindowSpec, sizes) -> dict[str, Column]:
    """Sample deviation of the previous rows."""
    out = {}
    for n in sizes:
        total = _last("before", n, w)
        variance = (_last("before_sq", n, w) - total * total / F.lit(float(n))) / F.lit(float(n - 1))
        out[f"roll_std_{n}"] = F.sqrt(F.when(variance > 0, variance).when(variance.isNotNull(), F.lit(0.0)))
    return out


def slope_columns() -> dict[str, Column]:
    return {
        "local_slope_1": F.col("lag_1") - F.col("lag_2"),
        "local_slope_2": F.col("lag_1") - F.col("lag_3"),
    }


def deviation_columns(now: str, day_before: str) -> dict[str, Column]:
    return {
        "daylag_deviation": F.col(now) - F.col(day_before),
        "prev_count_ratio_daylag": ratio(F.col(now), F.col(day_before)),
    }


def network_windows(counts: DataFrame, cfg: NetworkConfig, within: tuple[int, int] | None = None) -> DataFrame:
    """Dense series of every station with target, lags and rolling columns, from one shuffle and one sort."""
    w = slice_window(SERIES_KEY)
    sliced = sliced_series(counts, SERIES_KEY, cfg.slice_steps, cfg.lookback, cfg.horizon_steps, within)
    sliced = with_running(sliced, w)
    columns = {
        "target_h": horizon_target(w, cfg.horizon_steps),
        "target_daylag": daylag_target(w, cfg.horizon_steps, cfg.day_lag),
        **lag_columns(w, cfg.lags),
        **rolling_columns(w, cfg.rolls),
        **volatility_columns(w, cfg.volatility_rolls),
    }
    wide = sliced.select("*", *[c.alias(n) for n, c in columns.items()])
    return own_rows(wide, cfg.slice_steps).drop(*RUNNING)


def station_codes(stations: DataFrame, counted: DataFrame) -> DataFrame:
    """Stations that have counts, with dense codes for key, name and line and the raw ids as numbers."""
    present = stations.join(series_bounds(counted, SERIES_KEY).select("station_key"), "station_key", "left_semi")
    codes = {
        "station_key": "station_key_code",
        "ST_NAME_SHORT": "station_name_code",
        "LN_NAME_SHORT": "line_name_code",
    }
    coded = add_codes(present, codes)
    raw_line = F.coalesce(to_long(F.col("LN_CODE")), F.lit(-1))
    return coded.withColumns(
        {
            "station_id_raw": F.coalesce(to_long(F.col("ST_CODE")), F.lit(-1)),
            "line_id_raw": raw_line,
            "station_code": F.col("station_key_code"),
            "line_code": raw_line,
        }
    )


def attach_weather(frame: DataFrame, weather: DataFrame | None, time_col: str) -> DataFrame:
    """City weather of the anchor's hour; ``weather`` has one row per hour, so rows are never multiplied."""
    if weather is None:
        return frame
    hour = F.date_trunc("hour", F.col(time_col)).cast("timestamp_ntz")
    return frame.withColumn("weather_hour", hour).join(weather, "weather_hour", "left")


def network_frame(
    counts: DataFrame,
    stations: DataFrame | None,
    cfg: NetworkConfig,
    weather: DataFrame | None = None,
    within: tuple[int, int] | None = None,
) -> DataFrame:
    """The multi-station supervised frame; without ``stations`` it carries no static station columns."""
    windows = network_windows(counts, cfg, within)
    day = f"lag_{cfg.day_lag}"
    derived = {
        cfg.time_col: time_of(F.col("step"), cfg.bucket_minutes),
        **calendar_columns(F.col("step"), cfg),
        **slope_columns(),
        **deviation_columns("lag_1", day),
    }
    frame = windows.withColumns(derived).withColumn("operational_date", F.col("date"))
    frame = attach_weather(frame, weather, cfg.time_col)
    if stations is None:
        return frame
    static = station_codes(stations, counts)
    extra = ("n_place_ids", *STRUCTURE_COLUMNS)
    kept = [c for c in (*STATION_NAMES, *extra) if c in static.columns]
    codes = ["station_key_code", "station_name_code", "line_name_code", "station_id_raw", "line_id_raw"]
    static = static.select("station_key", *kept, *codes, "station_code", "line_code")
    return frame.join(static, "station_key", "left")


def station_frame(counts: DataFrame, cfg: StationConfig, within: tuple[int, int] | None = None) -> DataFrame:
    """The single-station supervised frame; context groups follow the settings."""
    day = cfg.day_lag
    w = slice_window(())
    sliced = with_running(sliced_series(counts, (), cfg.slice_steps, cfg.lookback, cfg.horizon_steps, within), w)
    context = set(cfg.context_features)
    columns = {
        "target_h": horizon_target(w, cfg.horizon_steps),
        "target_daylag": daylag_target(w, cfg.horizon_steps, day),
        "count_daylag": F.lag("count", day).over(w),
        "prev_count": F.lag("count", 1).over(w),
        "prev_count_daylag": F.lag("count", day + 1).over(w),
        **lag_columns(w, cfg.lags),
        **rolling_columns(w, cfg.rolls),
    }
    if "local_slope" in context:
        previous = F.lag("count", 1).over(w)
        columns["local_slope_1"] = previous - F.lag("count", 2).over(w)
        columns["local_slope_2"] = previous - F.lag("count", 3).over(w)
    if "rolling_volatility" in context:
        columns.update(volatility_columns(w, cfg.rolls[:1]))
    wide = sliced.select("*", *[c.alias(n) for n, c in columns.items()])
    frame = own_rows(wide, cfg.slice_steps).drop(*RUNNING)
    time = time_of(F.col("step"), cfg.bucket_minutes)
    calendar = calendar_columns(F.col("step"), cfg)
    if "hour_cyclical" not in context:
        calendar = {n: c for n, c in calendar.items() if n not in ("hour_sin", "hour_cos")}
    frame = frame.withColumns(
        {cfg.time_col: time, "calendar_date": time.cast("date"), **calendar, "operational_date": calendar["date"]}
    )
    if "daylag_deviation" in context:
        frame = frame.withColumns(deviation_columns("prev_count", "prev_count_daylag"))
    return frame


def sequence_windows(counts: DataFrame, cfg: SeriesConfig, window: int, keys: tuple[str, ...] = SERIES_KEY) -> DataFrame:
    """Per anchor, the last ``window`` counts as an array and the sum of the next horizon.

    A slice of a series, with its halo, is one ordered array; windows and targets are cuts of it, so no window operator
    keeps a buffer for each row.
    """
    span, horizon = cfg.slice_steps, cfg.horizon_steps
    sliced = sliced_series(counts, keys, span, window - 1, horizon)
    ordered = F.sort_array(F.collect_list(F.struct("step", "count")))
    arrays = sliced.groupBy(*keys, "slice").agg(ordered.alias("rows"))
    arrays = arrays.select(
        *keys, "slice", F.transform("rows", lambda x: x["count"]).alias("counts"), F.transform("rows", lambda x: x["step"]).alias("steps")
    )
    each = arrays.select("*", F.posexplode("steps").alias("place", "step")).filter(F.col("slice") == F.floor(F.col("step") / span))
    complete = each.filter((F.col("place") >= window - 1) & (F.col("place") + horizon < F.size("counts")))
    ahead = F.slice("counts", F.col("place") + 2, F.lit(horizon))
    return complete.select(
        *keys,
        "step",
        F.element_at("counts", F.col("place") + 1).alias("count"),
        F.slice("counts", F.col("place") + 2 - window, F.lit(window)).alias("history"),
        F.aggregate(ahead, F.lit(0.0), lambda a, x: a + x).alias("target_h"),
    )
