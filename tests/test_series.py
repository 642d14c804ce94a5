import numpy as np
import pandas as pd
import pytest
from helpers import counts_frame, pandas_features, same, step, three_stations
from pyspark.sql import functions as F

from ridertide.config import RICH_CONTEXT, NetworkConfig, StationConfig
from ridertide.operators import features
from ridertide.operators.buckets import station_counts
from ridertide.operators.densify import dense_series

CFG = NetworkConfig(bucket_minutes=240, horizon_minutes=720, line_codes=None)
KEY = ("station_key",)


@pytest.mark.parametrize("slice_days", [1, 2, 400])
def test_dense_series_fills_own_range(spark, slice_days):
    series = three_stations()
    cfg = CFG.but(slice_days=slice_days)
    got = dense_series(counts_frame(spark, series), KEY, cfg.slice_steps).toPandas()
    expected = pd.concat(
        [pd.DataFrame({"station_key": k, "step": first + np.arange(len(v)), "count": v}) for k, (first, v) in series.items()]
    )
    same(got, expected, ["station_key", "step"])


@pytest.mark.parametrize("slice_days", [1, 3, 400])
def test_windows_match_pandas_for_any_slicing(spark, slice_days):
    series = three_stations()
    cfg = CFG.but(slice_days=slice_days)
    got = features.network_windows(counts_frame(spark, series), cfg).toPandas()
    parts = []
    for key, (first, values) in series.items():
        part = pandas_features(first, values, cfg.lags, cfg.rolls, (2, 4), 3, cfg.day_lag)
        parts.append(part.assign(station_key=key))
    same(got, pd.concat(parts), ["station_key", "step"])


def test_range_limit_keeps_values(spark):
    series = three_stations()
    counts = counts_frame(spark, series)
    base = step("2024-01-01T03:00:00", 240)
    whole = features.network_windows(counts, CFG).filter(F.col("step").between(base + 15, base + 20)).toPandas()
    cut = features.network_windows(counts, CFG, within=(base + 15 - CFG.lookback, base + 20 + 3))
    same(cut.filter(F.col("step").between(base + 15, base + 20)).toPandas(), whole, ["station_key", "step"])


def test_no_feature_sees_its_own_or_later_rows(spark):
    series = three_stations()
    first, values = series["a"]
    changed = {"a": (first, values[:20] + [v + 100 for v in values[20:]])}
    cut = first + 20
    inputs = [c for c in features.network_windows(counts_frame(spark, series), CFG).columns if c.startswith(("lag_", "roll_"))]
    tables = []
    for data in ({"a": series["a"]}, changed):
        wide = features.network_windows(counts_frame(spark, data), CFG)
        tables.append(wide.filter(F.col("step") <= cut).select("step", *inputs).toPandas())
    same(tables[0], tables[1], ["step"])


def test_single_series_frame(spark):
    rng = np.random.default_rng(1)
    values = list(rng.integers(1, 9, 200).astype(float))
    cfg = StationConfig(
        bucket_minutes=60, horizon_minutes=120, lag_minutes=(60, 180, 1440), rolling_minutes=(120, 240),
        context_features=RICH_CONTEXT, slice_days=2,
    )
    first = step("2024-01-01T00:00:00", 60)
    counts = spark.createDataFrame([(first + i, float(v)) for i, v in enumerate(values)], "step bigint, count double")
    got = features.station_frame(counts, cfg).toPandas()
    expected = pandas_features(first, values, cfg.lags, cfg.rolls, (2,), 2, 24)
    s = pd.Series(values)
    expected["count_daylag"], expected["prev_count_daylag"] = s.shift(24), s.shift(25)
    expected["local_slope_2"] = s.shift(1) - s.shift(3)
    expected["daylag_deviation"] = s.shift(1) - s.shift(25)
    expected["prev_count_ratio_daylag"] = s.shift(1) / s.shift(25)
    same(got, expected, ["step"])
    plain = features.station_frame(counts, cfg.but(context_features=()))
    assert not {"hour_sin", "local_slope_1", "daylag_deviation", "roll_std_2"} & set(plain.columns)


def test_sequence_windows(spark):
    series = three_stations()
    got = features.sequence_windows(counts_frame(spark, series), CFG.but(slice_days=1), 5).collect()
    expected = {}
    for key, (first, v) in series.items():
        for i in range(4, len(v) - 3):
            expected[key, first + i] = (v[i - 4 : i + 1], sum(v[i + 1 : i + 4]))
    assert {(r["station_key"], r["step"]): (r["history"], r["target_h"]) for r in got} == expected


def test_codes_follow_sorted_values(spark):
    stations = spark.createDataFrame(
        [("b", 1, "Zoo", 1, "L"), ("a", 2, "Park", 1, "L"), ("c", 3, "Park", 2, "K"), ("z", 4, "Gone", 3, "A")],
        "station_key string, ST_CODE bigint, ST_NAME_SHORT string, LN_CODE bigint, LN_NAME_SHORT string",
    )
    counted = spark.createDataFrame([(k, 1, 1.0) for k in "abc"], "station_key string, step bigint, count double")
    rows = {r["station_key"]: r for r in features.station_codes(stations, counted).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert [rows[k]["station_key_code"] for k in "abc"] == [0, 1, 2]
    assert [rows[k]["station_name_code"] for k in "abc"] == [0, 1, 0]
    assert [rows[k]["line_name_code"] for k in "abc"] == [1, 1, 0]


def test_hot_place_folds_before_the_shuffle(spark):
    """A third of all taps at one place: counts stay whole and the join only meets counts."""
    taps = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50 + 1).alias("PLACE_ID"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 7200)").alias("TRAN_DATE"),
    )
    places = spark.range(51).select(F.col("id").alias("PLACE_ID"), F.format_string("s%d", F.col("id") % 5).alias("station_key"))
    counts = station_counts(taps, places, NetworkConfig(bucket_minutes=15, horizon_minutes=60))
    assert counts.agg(F.sum("count")).first()[0] == 90_000
    rows = counts.collect()
    assert len(rows) == 5 * 8
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.rindex("HashAggregate")


def test_one_shuffle_and_one_sort_for_all_windows(spark):
    wide = features.network_windows(counts_frame(spark, three_stations()), CFG)
    plan = wide._jdf.queryExecution().executedPlan().toString().splitlines()
    kinds = [line.strip(" :+-").split(" ")[0] for line in plan]
    assert kinds.count("Sort") == 1 and kinds.count("Window") == 2
    assert sum("REPARTITION_BY_COL" in line for line in plan) == 1
    below = kinds[kinds.index("Sort") :]
    assert "Window" not in below and sum(k == "Exchange" for k in kinds) == 2  # the other one is the bounds aggregate


def test_rolled_up_counts_are_the_coarse_counts(spark):
    from ridertide.config import StationConfig
    from ridertide.operators.buckets import rolled_up, series_counts

    events = spark.range(500).selectExpr("timestamp_ntz'2024-01-01 00:07:00' + make_interval(0, 0, 0, 0, 0, id * 11) AS TRAN_DATE")
    fine = series_counts(events, StationConfig(bucket_minutes=15, horizon_minutes=15))
    for minutes in (15, 30, 60, 360):
        cfg = StationConfig(bucket_minutes=minutes, horizon_minutes=minutes)
        want = {(r["step"], r["count"]) for r in series_counts(events, cfg).collect()}
        assert {(r["step"], r["count"]) for r in rolled_up(fine, 15, cfg).collect()} == want
