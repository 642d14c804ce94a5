import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridertide.config import TreeParams
from ridertide.operators import boosting, stumps

COLUMNS = ["a", "b", "c", "flat"]
SCHEMA = "id int, y double, w double, a double, b double, c int, flat int"


def random_rows(seed: int, n: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a = float(rng.integers(0, 12))
        b = None if rng.random() < 0.3 else float(rng.normal())
        c = None if rng.random() < 0.1 else int(rng.integers(0, 3))
        y = float(rng.integers(0, 5)) + (9 if b is None else 0) + (4 if a > 7 else 0)
        rows.append((i, y, float(rng.integers(1, 4)), a, b if i % 17 else math.nan, c, 1))
    return rows


def brute(rows, least: int, weighted: bool):
    """The best split by trying all of them on the rows themselves."""
    y = np.array([r[1] for r in rows])
    w = np.array([r[2] for r in rows]) if weighted else np.ones(len(rows))
    best = None
    for place, column in enumerate(COLUMNS):
        x = np.array([math.nan if r[3 + place] is None else round(float(r[3 + place]), 9) for r in rows])
        for t in sorted(set(x[~np.isnan(x)])):
            for missing_left in (False, True):
                left = np.where(np.isnan(x), missing_left, x <= t)
                if min(left.sum(), (~left).sum()) < least:
                    continue
                squared = lambda m: ((w * y)[m].sum()) ** 2 / w[m].sum()  # noqa: B023, E731
                gain = squared(left) + squared(~left) - (w * y).sum() ** 2 / w.sum()
                key = (-round(gain, 6), place, t, missing_left)
                if best is None or key < best[0]:
                    best = (key, np.average(y[left], weights=w[left]), np.average(y[~left], weights=w[~left]))
    return best


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("least", [1, 60])
def test_best_split_against_all_splits(spark, weighted, least):
    rows = random_rows(least, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = stumps.best_stump(df, COLUMNS, F.col("y"), F.col("w") if weighted else F.lit(1.0), least)
    (_, place, threshold, missing_left), left, right = brute(rows, least, weighted)
    assert (got.feature, got.threshold, got.missing_left) == (COLUMNS[place], threshold, missing_left)
    assert got.left == pytest.approx(left) and got.right == pytest.approx(right)


def test_sums_run_over_the_parts_of_a_feature(spark):
    """Many distinct values: thresholds in all parts, with the sums of a loop."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=2000), rng.integers(0, 9, 2000).astype(float)
    df = spark.createDataFrame(list(zip(map(float, x), map(float, y), strict=True)), "x double, y double")
    got = {r["threshold"]: r["gain"] for r in stumps.split_candidates(df, ["x"], F.col("y"), F.lit(1.0), 1).filter("not missing_left").collect()}
    order = np.argsort(x)
    s, n = np.cumsum(y[order]), np.arange(1, 2001)
    for i in range(0, 1999, 97):
        want = s[i] ** 2 / n[i] + (s[-1] - s[i]) ** 2 / (2000 - n[i]) - s[-1] ** 2 / 2000
        assert got[round(float(x[order][i]), 9)] == pytest.approx(want)
    assert len(got) == 1999


def test_without_a_split_the_mean(spark):
    df = spark.createDataFrame([(1.0, 5), (3.0, 5), (8.0, None)], "y double, flat int")
    got = stumps.best_stump(df, ["flat"], F.col("y"), F.lit(1.0), 2)
    assert got.feature is None and got.left == 4.0
    assert stumps.best_stump(df, [], F.col("y"), F.lit(1.0)).left == 4.0
    one = stumps.best_stump(df, ["flat"], F.col("y"), F.lit(1.0), 1)
    assert (one.feature, one.left, one.right, one.missing_left) == ("flat", 2.0, 8.0, False)


def test_rounds_lower_the_absolute_error(spark):
    df = spark.createDataFrame(random_rows(9, 400), SCHEMA).cache()
    errors = []
    for rounds in (1, 10):
        params = TreeParams(rounds, 0.2, 1, min_rows=5, exhaustive=True)
        fitted = boosting.fit_trees(df, COLUMNS, "y", params, 1)
        assert len(fitted.stumps) == rounds and sum(fitted.importances().values()) == pytest.approx(1.0)
        errors.append(fitted.add_prediction(df, "p").agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0])
    assert errors[1] < errors[0]


def test_fitting_needs_a_label(spark):
    df = spark.createDataFrame([(None, 1.0)], "y double, a double")
    with pytest.raises(ValueError, match="target"):
        stumps.fit_stumps(df, ["a"], "y", 1, 0.1)


def test_candidates_at_a_time_give_the_forecasts_of_one_after_another(spark):
    """Any number of threads fits the same models."""
    rng = np.random.default_rng(5)
    rows = []
    for fold, role, n in (("tune", "train", 120), ("tune", "eval", 40), ("full", "train", 160), ("full", "eval", 40)):
        for i in range(n):
            a, b = float(rng.integers(0, 9)), float(rng.normal())
            rows.append((fold, role, "k", i, a, b, 3 * a + b, 1.0, 0, 5.0))
    schema = "fold string, role string, station_key string, step int, a double, b double, target_h double, station_train_mean_target double, hl_actual int, global_mean_target double"
    table = spark.createDataFrame(rows, schema).cache()
    from ridertide.config import NetworkConfig

    grid = (TreeParams(2, 0.3, 2), TreeParams(1, 0.1, 1, exhaustive=True), TreeParams(3, 0.3, 1))
    found = []
    for threads in (1, 4):
        cfg = NetworkConfig(tree_grid=grid, top_k=2, fit_threads=threads)
        expert = boosting.network_trees(table, ["a", "b"], cfg, "x")
        scores = sorted((r["model"], round(r["mae"], 9)) for r in expert.scores.collect())
        found.append((expert.chosen, scores, sorted((r["fold"], r["step"], round(r["pred"], 9)) for r in expert.forecasts.collect())))
    assert found[0] == found[1]
