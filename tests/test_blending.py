import numpy as np
import pytest
from pyspark.sql import functions as F

from ridertide.config import TreeParams
from ridertide.operators import blending, context

SCHEMA = "y_true double, m1 double, m2 double, m3 double, hl_daylag int, w double"


def table(spark, n=200, seed=1, perfect=False):
    rng = np.random.default_rng(seed)
    y = rng.poisson(6, n).astype(float)
    m = np.column_stack([y + rng.normal(0, s, n) for s in (1.0, 2.0, 3.0)])
    if perfect:
        m[:, 1] = y
    hl, w = (y > 7).astype(int), rng.uniform(0.25, 8, n)
    rows = [tuple(map(float, r[:4])) + (int(r[4]), float(r[5])) for r in np.column_stack([y, m, hl, w])]
    return spark.createDataFrame(rows, SCHEMA), y, m, hl, w


MODELS = ["m1", "m2", "m3"]


def solve(x, y, w):
    free = np.zeros(x.shape[1])
    gram, moment = x.T @ (x * w[:, None]), x.T @ (w * y)
    for _ in range(6_000):
        free = np.maximum(free - (gram @ free - moment) / np.linalg.norm(gram, 2), 0)
    return free / free.sum()


def test_weights_overall_and_by_context(spark):
    df, y, m, hl, w = table(spark)
    blend = blending.fit_blend(df, MODELS, 30, F.col("w"))
    np.testing.assert_allclose(blend.overall, solve(m, y, w), atol=1e-4)
    for c in (0, 1):
        part = hl == c
        np.testing.assert_allclose(blend.by_context[c], solve(m[part], y[part], w[part]), atol=1e-4)
    row = df.select(blend.static().alias("s"), blend.contextual().alias("c"), *MODELS, "hl_daylag").first()
    values = np.array([row[k] for k in MODELS])
    assert row["s"] == pytest.approx(values @ blend.overall)
    assert row["c"] == pytest.approx(values @ blend.by_context[row["hl_daylag"]])
    assert blend.weights(spark).count() == 9


def test_small_context_takes_overall_weights(spark):
    df, _, _, hl, _ = table(spark)
    blend = blending.fit_blend(df, MODELS, int((hl == 0).sum()))
    np.testing.assert_array_equal(blend.by_context[1], blend.overall)
    assert not np.array_equal(blend.by_context[0], blend.overall)
    assert blending.network_least_rows(MODELS) == 30 and blending.station_least_rows(MODELS * 2) == 36
    with pytest.raises(ValueError):
        blending.fit_blend(df.filter("y_true < 0"), MODELS, 30)


def test_a_perfect_model_takes_all(spark):
    df, *_ = table(spark, perfect=True)
    np.testing.assert_allclose(blending.fit_blend(df, MODELS, 30).overall, [0, 1, 0], atol=1e-9)


def test_pool(spark):
    def pool(rows, **kw):
        return blending.select_pool(spark.createDataFrame(rows, "model string, lw_mae double"), **kw)

    assert pool([("seasonal", 2.0), ("a", 2.09), ("b", 2.2)]) == ["seasonal", "a"]
    assert pool([("seasonal", 2.0), ("a", 2.2), ("b", 2.3), ("c", 2.4)]) == ["seasonal", "a", "b"]
    assert pool([("a", 1.0), ("b", 1.04), ("c", 3.0)]) == ["a", "b"]
    assert pool([("seasonal", 2.0)]) == ["seasonal"]


@pytest.mark.parametrize("weight", [None, "w"])
def test_ridge_equals_the_normal_equations(spark, weight):
    df, y, m, hl, w = table(spark)
    df = df.withColumn("flat", F.lit(3.0)).withColumn("hl", F.col("hl_daylag").cast("double"))
    df = df.withColumn("twin", F.col("m1"))
    features = ["m1", "m2", "m3", "hl", "flat", "twin"]
    x = np.column_stack([m, hl, np.full(len(y), 3.0), m[:, 0]])
    k = w if weight else np.ones(len(y))
    xm, ym = (k[:, None] * x).sum(0) / k.sum(), (k * y).sum() / k.sum()
    xc = x - xm
    coef = np.linalg.solve(xc.T @ (k[:, None] * xc) + 10 * np.eye(6), xc.T @ (k * (y - ym)))
    fit = blending.fit_ridge(df, features, "y_true", 10.0, weight)
    np.testing.assert_allclose(fit.coefficients, coef, atol=1e-8)
    assert fit.intercept == pytest.approx(ym - coef @ xm)
    got = np.array([r[0] for r in df.select(fit.value()).collect()])
    np.testing.assert_allclose(got, x @ coef + ym - coef @ xm, atol=1e-8)
    constant = blending.fit_ridge(df.withColumn("k", F.lit(2.5)), features, "k", 10.0)
    assert constant.intercept == 2.5 and not constant.coefficients.any()


def test_meta_features(spark):
    df, _, m, _, _ = table(spark, n=5)
    built = blending.meta_features(MODELS, "m2", ["hl_daylag"], extremes=True)
    row = df.select(*[c.alias(n) for n, c in built.items()]).first()
    assert row["diff_m1_minus_m2"] == pytest.approx(m[0, 0] - m[0, 1])
    assert row["absdiff_m3_m2"] == pytest.approx(abs(m[0, 2] - m[0, 1]))
    assert (row["pred_std"], row["pred_range"]) == (pytest.approx(m[0].std()), pytest.approx(np.ptp(m[0])))
    assert row["pred_min"] == m[0].min() and "diff_m2_minus_m2" not in built


def test_residual_corrections_stay_within_bounds(spark):
    df, y, m, *_ = table(spark)
    resid = blending.with_residual(df, "m3")
    low, high = blending.residual_bounds(resid, "m3", (0.05, 0.95))
    np.testing.assert_allclose([low, high], np.quantile(y - m[:, 2], [0.05, 0.95]))
    trees = blending.fit_residual_trees(resid, ["m1", "m2", "m3"], TreeParams(5, 0.3, 2, min_rows=5), 7, "w")
    scored = trees.add_prediction(resid, "c").select(
        (blending.corrected("m3", F.col("c") * 100, (low, high)) - F.col("m3")).alias("d")
    )
    ends = scored.agg(F.min("d"), F.max("d")).first()
    assert ends[0] >= low - 1e-9 and ends[1] <= high + 1e-9
    terms = blending.importance_terms(trees, spark)
    assert terms.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_direct_blend(spark):
    df, *_ = table(spark)
    scored = blending.direct_blend(df, df, ["m1", "m2", "hl_daylag"], TreeParams(10, 0.2, 2), 3, "direct")
    error = scored.agg(F.avg(F.abs(F.col("direct") - F.col("y_true"))), F.stddev("y_true")).first()
    assert error[0] < error[1]


def test_sample_weight(spark):
    rows = [(4.0, 2.0), (0.0, 2.0), (100.0, 2.0), (4.0, 0.0), (4.0, None), (4.0, 8.0)]
    df = spark.createDataFrame(rows, "y_true double, station_train_mean_target double")
    typical = context.median_station_mean(df)
    weight = context.sample_weight(F.col("y_true"), F.col("station_train_mean_target"), F.lit(typical), 1.0)
    assert [r[0] for r in df.select(weight).collect()] == [2.0, 0.25, 8.0, 2.0, 2.0, 0.5]
