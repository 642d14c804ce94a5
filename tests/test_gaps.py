"""Missing forecasts, stations that the map lacks, folds without train targets."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ridertide.config import StationConfig
from ridertide.operators import blending, context


def gaps(spark):
    rng = np.random.default_rng(8)
    y = rng.uniform(1, 9, 200)
    rows = [("tune" if i % 2 else "full", float(v), float(v), None if i % 3 == 0 else float(v + rng.normal()), i % 2) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "fold string, y_true double, a double, b double, hl_daylag int")


def test_blend_uses_complete_rows(spark):
    df = gaps(spark)
    whole = blending.fit_blend(df, ["a", "b"], 30)
    complete = blending.fit_blend(df.dropna(), ["a", "b"], 30)
    np.testing.assert_allclose(whole.overall, complete.overall)
    np.testing.assert_allclose(whole.overall, [1, 0], atol=1e-9)
    for c in (0, 1):
        np.testing.assert_allclose(whole.by_context[c], complete.by_context[c])


def test_blend_without_complete_rows_is_an_error(spark):
    df = gaps(spark).withColumn("b", F.lit(None).cast("double"))
    with pytest.raises(ValueError, match="no validation row"):
        blending.fit_blend(df, ["a", "b"], 30)


def test_missing_forecasts_are_named(spark):
    df = gaps(spark)
    blending.require_forecasts(df, ["a"])
    with pytest.raises(ValueError, match=r"b in fold full: 34; b in fold tune: 33"):
        blending.require_forecasts(df, ["a", "b"])
    with pytest.raises(ValueError, match="a in fold tune"):
        blending.require_forecasts(df.withColumn("a", F.when(F.col("fold") == "full", 1.0).otherwise(float("nan"))), ["a"])


def test_meta_features_keep_missing_forecasts_missing(spark):
    built = blending.meta_features(["a", "b"], "a", ["hl_daylag"])
    rows = gaps(spark).withColumn("hl_daylag", F.lit(None).cast("int")).select("b", *[c.alias(n) for n, c in built.items()]).collect()
    assert all((r["pred_b"] is None) == (r["b"] is None) and r["hl_daylag"] == 0 for r in rows)


def test_fold_without_train_targets_is_an_error(spark):
    rows = [("tune", "train", 1, None, 2.0), ("tune", "eval", 2, 3.0, 2.0)]
    folds = spark.createDataFrame(rows, "fold string, role string, step long, target_h double, target_daylag double")
    with pytest.raises(PySparkException, match="no train target in fold tune"):
        context.attach_series_context(folds, StationConfig()).collect()
