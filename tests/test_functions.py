import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridertide.config import NetworkConfig, StationConfig, station_presets
from ridertide.functions import calendar, text
from ridertide.functions.draws import draw
from ridertide.functions.linalg import nonnegative_blend
from ridertide.functions.numeric import finite, flag, ratio, row_std, to_long


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()])
    return row.select(column.alias("x")).first()[0]


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("12",), ("12.0",), (" 7 ",), ("x",), (None,), ("-3",)], "v string")
    assert [r[0] for r in df.select(to_long(F.col("v"))).collect()] == [12, 12, 7, None, None, -3]


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 2.0), (float("inf"), 2.0), (3.0, 2.0)], "a double, b double")
    rows = df.select(finite(F.col("a")), ratio(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [1.0, None, None, 3.0]
    assert rows[0][1] is None and rows[3][1] == 1.5
    assert one(spark, flag(F.lit(None).cast("double") > 1)) == 0


def test_row_std_is_population(spark):
    value = one(spark, row_std([F.col("a"), F.col("b"), F.col("c")]), a=1.0, b=2.0, c=6.0)
    assert value == pytest.approx(np.std([1, 2, 6]))


def test_station_keys(spark):
    assert one(spark, text.station_key(F.lit(8), F.lit(12))) == "ln00008_st00012"
    cases = [("8", "12", "ln00008_st00012"), ("8.0", "a-b!", "ln00008_st00a_b"), (None, "123456", "ln000NA_st123456")]
    for line, station, key in cases:
        line_col = F.lit(line).cast("string")
        assert one(spark, text.loose_station_key(line_col, F.lit(station))) == key


def test_tidy_names():
    assert text.tidy_name("﻿ place id ") == "PLACE_ID"


@pytest.mark.parametrize("minutes", [15, 60, 360])
def test_grid_round_trip(spark, minutes):
    times = [dt.datetime(2024, 1, 1, 0, 0, 7), dt.datetime(2024, 2, 29, 23, 59, 59), dt.datetime(1969, 12, 31, 22, 1)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    step = calendar.step_of(F.col("ts"), minutes)
    for t, got in zip(times, [r[0] for r in df.select(calendar.time_of(step, minutes)).collect()]):
        midnight = t.replace(hour=0, minute=0, second=0)
        whole = int((t - midnight).total_seconds() // 60) // minutes
        assert got == midnight + dt.timedelta(minutes=minutes * whole)


def test_operating_day(spark):
    cfg = NetworkConfig(bucket_minutes=15, horizon_minutes=60)
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 2, 45),), (dt.datetime(2024, 1, 1, 3, 15),)], "ts timestamp_ntz")
    columns = calendar.calendar_columns(calendar.step_of(F.col("ts"), 15), cfg)
    before, after = df.select(*[c.alias(n) for n, c in columns.items()]).collect()
    assert (before["date"], before["day_of_week"], before["slot_in_day"]) == (dt.date(2023, 12, 31), 6, 95)
    assert (after["date"], after["day_of_week"], after["slot_in_day"]) == (dt.date(2024, 1, 1), 0, 1)
    assert after["hour_sin"] == pytest.approx(np.sin(2 * np.pi / 96))


def test_config_guards():
    with pytest.raises(ValueError):
        NetworkConfig(bucket_minutes=15, horizon_minutes=50)
    with pytest.raises(ValueError):
        NetworkConfig(bucket_minutes=25, horizon_minutes=50)
    assert StationConfig(bucket_minutes=60, horizon_minutes=360).lags == (1, 2, 3, 4, 6, 24, 48)
    assert StationConfig().rolls == (2, 4, 8, 12, 16)
    assert station_presets()["60m_360m"].block_size == 6


def test_draws_spread_like_independent_ones(spark):
    n, reps = 40, 500
    base = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    drawn = base.select("rep", draw(F.col("rep"), F.col("i"), 3228, F.lit(n)).alias("k"))
    times = drawn.groupBy("rep", "k").count().toPandas()
    assert times["k"].between(0, n - 1).all()
    distinct = times.groupby("rep").size().mean() / n
    assert distinct == pytest.approx(1 - (1 - 1 / n) ** n, abs=0.02)
    second_moment = (times["count"] ** 2).sum() / reps / n
    assert second_moment == pytest.approx(2 - 1 / n, rel=0.03)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 5))
def test_blend_weights_are_optimal(seed, k):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(2, 1, (60, k)), rng.normal(2, 1, 60)
    weights = nonnegative_blend(x.T @ x, x.T @ y)
    assert (weights >= 0).all() and weights.sum() == pytest.approx(1)
    free = np.zeros(k)
    for _ in range(4000):
        free = np.maximum(free - (x.T @ x @ free - x.T @ y) / np.linalg.norm(x.T @ x, 2), 0)
    if free.sum() > 1e-6:
        np.testing.assert_allclose(weights, free / free.sum(), atol=1e-3)


def test_blend_degenerate():
    np.testing.assert_allclose(nonnegative_blend(np.zeros((3, 3)), np.zeros(3)), [1 / 3] * 3)
    np.testing.assert_allclose(nonnegative_blend(np.eye(2), np.array([-1.0, -2.0])), [0.5, 0.5])
    np.testing.assert_allclose(nonnegative_blend(np.ones((2, 2)), np.ones(2)).sum(), 1.0)
