"""Pooled sequence expert: one linear autoregression over the standardized windows of all stations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridertide.config import SeriesConfig
from ridertide.operators.folds import EVAL, TRAIN
from ridertide.session import stage

SPREAD_FLOOR = 1e-8
# A little shrinkage keeps the fit unique where a series has fewer windows than steps in a window.
SHRINKAGE = 0.01


def scaled_windows(
    folds: DataFrame, cfg: SeriesConfig, window: int, keys: tuple[str, ...] = ("station_key",)
) -> DataFrame:
    """Per anchor and fold, the standardized history and target.

    Standardized by mean and population deviation of the station's train days. Train windows lie wholly inside the
    train days; evaluation windows may reach back into them. A (fold, station) group is one array of at most four days;
    windows are cuts of it.
    """
    horizon = cfg.horizon_steps
    count, trained = F.col("count").cast("double"), F.col("role") == TRAIN
    train_count = F.when(trained, count)
    ordered = F.sort_array(F.collect_list(F.struct("step", "role", count.alias("count"))))
    series = folds.groupBy("fold", *keys).agg(
        ordered.alias("rows"),
        F.avg(train_count).alias("series_mean"),
        (F.stddev_pop(train_count) + F.lit(SPREAD_FLOOR)).alias("series_std"),
        F.count(train_count).alias("n_train"),
        F.count(F.when(~trained, count)).alias("n_eval"),
    )
    series = series.filter((F.col("n_train") >= window + horizon + 1) & (F.col("n_eval") >= horizon + 1))
    counts = F.transform("rows", lambda x: x["count"]).alias("counts")
    each = series.select("fold", *keys, "series_mean", "series_std", "n_train", counts, F.posexplode("rows").alias("place", "row"))
    # Train days come before the evaluation day, so a train row's target must end with them.
    limit = F.when(F.col("row.role") == TRAIN, F.col("n_train")).otherwise(F.size("counts"))
    usable = each.filter((F.col("place") >= window - 1) & (F.col("place") + horizon < limit))
    mean, std = F.col("series_mean"), F.col("series_std")
    history = F.slice("counts", F.col("place") + 2 - window, F.lit(window))
    future = F.aggregate(F.slice("counts", F.col("place") + 2, F.lit(horizon)), F.lit(0.0), lambda a, x: a + x)
    return usable.select(
        "fold",
        F.col("row.role").alias("role"),
        *keys,
        F.col("row.step").alias("step"),
        F.transform(history, lambda x: (x - mean) / std).alias("history"),
        ((future - horizon * mean) / std).alias("target_scaled"),
        "series_mean",
        "series_std",
    )


def unscaled(prediction, cfg: SeriesConfig):
    """Back to passengers, not below zero."""
    value = prediction * F.col("series_std") + cfg.horizon_steps * F.col("series_mean")
    return F.greatest(value, F.lit(0.0))


@dataclass
class Autoregression:
    """Weights of the window's values, oldest first, and the constant."""

    weights: np.ndarray
    constant: float

    def value(self) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in self.weights])
        products = F.zip_with("history", weights, lambda x, w: x * w)
        return F.aggregate(products, F.lit(self.constant), lambda a, x: a + x)


def window_sums(windows: DataFrame, window: int) -> dict[str, np.ndarray]:
    """By fold, the products summed over all windows: of the values with each other, the target and 1.

    A window gives one row for each of its values; the row's products with all others are summed in the same aggregate,
    so only (window + 2) x (window + 2) sums per fold and task are shuffled and reach the driver.
    """
    y = F.col("target_scaled")
    extended = F.concat("history", F.array(y, F.lit(1.0)))
    rows = windows.select("fold", extended.alias("values"))
    rows = rows.select("fold", "values", F.posexplode("values").alias("place", "value"))
    sums = [F.sum(F.col("value") * F.col("values")[j]).alias(f"s{j}") for j in range(window + 2)]
    out: dict[str, np.ndarray] = {}
    for r in rows.groupBy("fold", "place").agg(*sums).collect():
        out.setdefault(r["fold"], np.zeros((window + 2, window + 2)))[r["place"]] = [r[f"s{j}"] for j in range(window + 2)]
    return out


def solved(sums: np.ndarray, shrinkage: float = SHRINKAGE) -> Autoregression:
    """Least squares with a free constant and a penalty on the weights, from the summed products.

    The penalty is in units of the target's spread: shrinkage times rows times spread. A window value that never
    changes takes no weight.
    """
    k = len(sums) - 2
    n = sums[-1, -1]
    means = sums[-1, : k + 1] / n
    centred = sums[: k + 1, : k + 1] - n * np.outer(means, means)
    spread = np.sqrt(max(centred[k, k] / n, 0.0))
    gram = centred[:k, :k] + np.eye(k) * max(shrinkage * n / spread if spread else 0.0, 0.0)
    varying = np.flatnonzero(np.diag(centred)[:k] > 0)
    weights = np.zeros(k)
    if spread and len(varying):
        part = np.ix_(varying, varying)
        weights[varying] = np.linalg.lstsq(gram[part], centred[varying, k], rcond=None)[0]
    return Autoregression(weights, float(means[k] - weights @ means[:k]))


def fit_autoregression(windows: DataFrame, window: int) -> dict[str, Autoregression]:
    """One fit per fold, from the train windows."""
    return {fold: solved(sums) for fold, sums in window_sums(windows.filter(F.col("role") == TRAIN), window).items()}


def pooled_autoregression(
    folds: DataFrame, cfg: SeriesConfig, window: int, keys: tuple[str, ...] = ("station_key",)
) -> DataFrame:
    """Forecasts of the evaluation anchors of both folds: (fold, keys..., step, pred). A fold without a train window
    has no forecasts."""
    windows = stage(scaled_windows(folds, cfg, window, keys))
    fits = fit_autoregression(windows, window)
    value = F.lit(None).cast("double")
    for fold, fit in fits.items():
        value = F.when(F.col("fold") == fold, fit.value()).otherwise(value)
    ahead = windows.filter((F.col("role") == EVAL) & F.col("fold").isin(*fits))
    return ahead.select("fold", *keys, "step", unscaled(value, cfg).alias("pred"))
