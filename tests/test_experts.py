import numpy as np
import pytest
from helpers import step
from pyspark.sql import functions as F

from ridertide.config import RICH_CONTEXT, NetworkConfig, StationConfig, TreeParams
from ridertide.operators import boosting, context, features, folds, forecasts, sequence, smoothing
from ridertide.operators.metrics import micro_metrics

CFG = NetworkConfig(bucket_minutes=240, horizon_minutes=480, line_codes=None, seq_window=4)
DAY = CFG.day_lag


def fold_rows(spark, train, ahead, key="a", fold="tune"):
    rows = [(fold, "train", key, i, float(v)) for i, v in enumerate(train)]
    rows += [(fold, "eval", key, len(train) + i, float(v)) for i, v in enumerate(ahead)]
    return spark.createDataFrame(rows, "fold string, role string, station_key string, step bigint, count double")


def test_holt_winters_repeats_a_pure_season(spark):
    season = np.array([10.0, 20, 30, 20, 10, 0])
    rows = fold_rows(spark, np.tile(season, 3), season)
    got = [r["pred"] for r in smoothing.holt_winters(rows, CFG).orderBy("step").collect()]
    np.testing.assert_allclose(got, [season[i + 1 : i + 3].sum() for i in range(DAY - 2)], atol=1e-9)


def test_holt_winters_follows_a_trend_and_can_go_below_zero(spark):
    season = np.array([0.0, 2, 4, 2, 0, -8])
    line = 60 - 1.0 * np.arange(4 * DAY)
    path = line + np.tile(season, 4)
    rows = fold_rows(spark, path[: 3 * DAY], path[3 * DAY :])
    got = [r["pred"] for r in smoothing.holt_winters(rows, CFG, floor=False).orderBy("step").collect()]
    expected = [path[3 * DAY + i + 1 : 3 * DAY + i + 3].sum() for i in range(DAY - 2)]
    np.testing.assert_allclose(got, expected, rtol=0.25, atol=6)
    sinking = 10 - 3.0 * np.arange(4 * DAY)
    rows = fold_rows(spark, sinking[: 3 * DAY], sinking[3 * DAY :])
    assert min(r["pred"] for r in smoothing.holt_winters(rows, CFG).collect()) == 0.0
    assert max(r["pred"] for r in smoothing.holt_winters(rows, CFG, floor=False).collect()) < 0


def test_holt_winters_skips_short_series(spark):
    rows = fold_rows(spark, np.ones(2 * DAY - 1), np.ones(DAY)).unionByName(
        fold_rows(spark, np.ones(2 * DAY), np.ones(DAY), "b")
    )
    assert {r["station_key"] for r in smoothing.holt_winters(rows, CFG).collect()} == {"b"}


def test_holt_winters_without_station_key(spark):
    rows = fold_rows(spark, np.ones(2 * DAY), np.ones(DAY)).drop("station_key")
    assert smoothing.holt_winters(rows, CFG, ()).columns == ["fold", "step", "pred"]
    assert smoothing.holt_winters(rows, CFG, ()).count() == DAY - 2


def test_scaled_windows_match_a_loop(spark):
    rng = np.random.default_rng(8)
    train, ahead = rng.poisson(6, 2 * DAY).astype(float), rng.poisson(6, DAY).astype(float)
    rows = fold_rows(spark, train, ahead).unionByName(fold_rows(spark, train[:6], ahead, "short"))
    got = {(r["role"], r["step"]): r for r in sequence.scaled_windows(rows, CFG, 4).collect()}
    mean, std = train.mean(), train.std() + 1e-8
    both, h = (np.concatenate([train, ahead]) - mean) / std, CFG.horizon_steps
    expected = {("train", i) for i in range(3, len(train) - h)} | {("eval", i) for i in range(len(train), len(both) - h)}
    assert set(got) == expected
    for (role, i), r in got.items():
        np.testing.assert_allclose(r["history"], both[i - 3 : i + 1])
        assert r["target_scaled"] == pytest.approx(both[i + 1 : i + 1 + h].sum())


def test_pooled_autoregression_learns_a_shared_shape(spark):
    t = np.arange(4 * DAY)
    parts = []
    for key, size in (("a", 10.0), ("b", 200.0)):
        path = size * (2 + np.sin(2 * np.pi * t / DAY))
        for fold, n in (("tune", 2), ("full", 3)):
            parts.append(fold_rows(spark, path[: n * DAY], path[n * DAY : (n + 1) * DAY], key, fold))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = sequence.pooled_autoregression(rows, CFG, 4)
    for r in got.collect():
        size = 10.0 if r["station_key"] == "a" else 200.0
        future = size * (2 + np.sin(2 * np.pi * (r["step"] + np.arange(1, 3)) / DAY))
        assert r["pred"] == pytest.approx(future.sum(), rel=0.06)


def loop_holt_winters(train, ahead, floor):
    """All constants by a loop; the first of those with the least squared error."""
    first, second = train[:DAY].mean(), train[DAY : 2 * DAY].mean()
    best = None
    for a, b, c in smoothing.CONSTANTS:
        level, trend, season, cost = first, (second - first) / DAY, list(train[:DAY] - first), 0.0
        for i, y in enumerate(train):
            s = season[i % DAY]
            cost += (y - level - trend - s) ** 2
            raised = a * (y - s) + (1 - a) * (level + trend)
            trend = b * (raised - level) + (1 - b) * trend
            season[i % DAY] = c * (y - raised) + (1 - c) * s
            level = raised
        if best is None or round(cost, smoothing.DIGITS) < best[0]:
            best = (round(cost, smoothing.DIGITS), level, trend, season)
    _, level, trend, season = best
    path = [level + k * trend + season[(len(train) + k - 1) % DAY] for k in range(1, ahead + 1)]
    path = np.maximum(path, 0) if floor else np.array(path)
    return [path[i + 1 : i + 3].sum() for i in range(ahead - 2)]


@pytest.mark.parametrize("floor", [True, False])
def test_holt_winters_against_a_loop(spark, floor):
    rng = np.random.default_rng(6)
    rows, want = None, {}
    for key, days in (("a", 2), ("b", 3), ("c", 3)):
        train = rng.poisson(rng.integers(1, 30), days * DAY + 1).astype(float)
        part = fold_rows(spark, train, np.ones(DAY), key)
        rows = part if rows is None else rows.unionByName(part)
        want.update({(key, len(train) + i): v for i, v in enumerate(loop_holt_winters(train, DAY, floor))})
    got = {(r["station_key"], r["step"]): r["pred"] for r in smoothing.holt_winters(rows, CFG, floor=floor).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_holt_winters_needs_no_python_worker(spark):
    plan = smoothing.holt_winters(fold_rows(spark, np.ones(2 * DAY), np.ones(DAY)), CFG)._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan


def test_holt_winters_skips_missing_counts(spark):
    rows = fold_rows(spark, np.ones(2 * DAY), np.ones(DAY))
    assert smoothing.holt_winters(rows.withColumn("count", F.when(F.col("step") != 3, F.col("count"))), CFG).count() == 0


def test_autoregression_equals_least_squares(spark):
    """The sums of products give the fit of the iterative learner on the same windows."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(7)
    rows = fold_rows(spark, rng.poisson(9, 3 * DAY).astype(float), rng.poisson(9, DAY).astype(float))
    windows = sequence.scaled_windows(rows, CFG, 4).cache()
    fit = sequence.fit_autoregression(windows, 4)["tune"]
    learner = LinearRegression(
        featuresCol="x", labelCol="target_scaled", solver="normal", standardization=False, regParam=sequence.SHRINKAGE
    )
    model = learner.fit(windows.filter("role = 'train'").withColumn("x", array_to_vector("history")))
    np.testing.assert_allclose(fit.weights, model.coefficients.toArray(), atol=1e-8)
    assert fit.constant == pytest.approx(model.intercept, abs=1e-8)


def test_autoregression_of_constant_windows():
    sums = np.array([[9.0, 0, 3, 9], [0, 0, 0, 0], [3, 0, 2, 3], [9, 0, 3, 9]])
    fit = sequence.solved(sums)
    assert fit.weights.tolist() == [0.0, 0.0] and fit.constant == pytest.approx(1 / 3)


def test_aligned_forecasts(spark):
    anchors = spark.createDataFrame([("tune", "a", 1, 5.0), ("tune", "b", 1, None), ("full", "a", 2, 7.0)], "fold string, station_key string, step int, seasonal double")
    first = spark.createDataFrame([("tune", "a", 1, 1.5), ("full", "a", 2, 2.5), ("full", "z", 9, 9.0)], "fold string, station_key string, step int, pred double")
    second = spark.createDataFrame([("tune", "b", 1, 3)], "fold string, station_key string, step int, pred int")
    keys = ["fold", "station_key", "step"]
    out = forecasts.aligned(anchors, {"one": first, "two": second}, keys, {"two": F.col("seasonal"), "one": None})
    assert out.columns == [*keys, "seasonal", "one", "two", "without"]
    got = {tuple(r)[:3]: (r["one"], r["two"], r["without"]) for r in out.collect()}
    assert got == {("tune", "a", 1): (1.5, 5.0, ["two"]), ("tune", "b", 1): (None, 3.0, ["one"]), ("full", "a", 2): (2.5, 7.0, ["two"])}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_feature_sets():
    sets = boosting.feature_sets(StationConfig())
    assert list(sets) == ["lags_short", "lags_hour", "lags_day_time", "lags_day_time_ctx", "lags_extended", "lags_extended_ctx"]
    assert sets["lags_short"] == ["lag_1", "lag_2", "lag_3", "roll_sum_2", "roll_mean_2"]
    assert sets["lags_day_time"][-4:] == ["lag_96", "lag_97", "hour_sin", "hour_cos"]
    assert sets["lags_extended_ctx"][-5:] == ["hour_sin", "hour_cos", "roll_sum_4", "roll_mean_8", "hl_daylag"]
    plain = boosting.feature_sets(StationConfig(boosting_context_features=()))
    assert list(plain) == ["lags_short", "lags_hour", "lags_day_time", "lags_extended"]
    rich = boosting.feature_sets(StationConfig(context_features=RICH_CONTEXT))["lags_day_time_ctx"]
    assert rich[-3:] == ["daylag_deviation", "prev_count_ratio_daylag", "roll_std_2"]
    base = boosting.base_features(NetworkConfig(bucket_minutes=60, horizon_minutes=60))
    assert base.count("lag_24") == 1 and "lag_25" in base


@pytest.fixture(scope="module")
def attached(spark):
    rng = np.random.default_rng(9)
    first = step("2024-01-01T03:00:00", 240)
    rows = []
    for key, size in (("a", 5.0), ("b", 60.0)):
        shape = size * (2 + np.sin(2 * np.pi * np.arange(5 * DAY) / DAY))
        rows += [(key, first + i, float(v)) for i, v in enumerate(rng.poisson(shape) + 1.0)]
    counts = spark.createDataFrame(rows, "station_key string, step bigint, count double")
    dates = folds.fold_dates(counts, CFG)
    split = folds.day_folds(features.network_frame(counts, None, CFG), dates, CFG)
    return context.attach_context(folds.clip_per_day(split, CFG), CFG).cache()


def test_tree_expert_picks_and_averages(attached):
    cfg = CFG.but(tree_grid=(TreeParams(1, 0.1, 1), TreeParams(15, 0.2, 3)), top_k=1)
    expert = boosting.network_trees(attached, ["lag_1", "lag_6", "roll_sum_4", "hour_sin", "missing"], cfg, "x")
    assert expert.chosen == ["x__cfg2"] and expert.scores.count() == 2
    rows = attached.filter("role = 'eval'")
    assert expert.forecasts.count() == rows.count()
    joined = rows.join(expert.forecasts, ["fold", "station_key", "step"]).withColumnRenamed("target_h", "y_true")
    joined = joined.filter("fold = 'full'").withColumn("mean", F.col("global_mean_target"))
    scores = {r["model"]: r["mae"] for r in micro_metrics(joined, ["pred", "mean"]).collect()}
    assert scores["pred"] < scores["mean"]


def test_normalized_trees_are_not_negative(attached):
    cfg = CFG.but(tree_grid=(TreeParams(8, 0.2, 3),))
    expert = boosting.normalized_trees(attached, ["lag_1", "lag_6", "target_daylag", "hour_sin"], cfg, "x")
    low = expert.forecasts.agg(F.min("pred"), F.count(F.when(F.col("pred").isNull(), 1))).first()
    assert low[0] >= 0 and low[1] == 0


def test_training_needs_targets(attached):
    with pytest.raises(ValueError, match="target"):
        boosting.fit_trees(attached.filter("target_h is null"), ["lag_1"], "target_h", TreeParams(1, 0.1, 1), 1)
