"""Blends of expert forecasts, and models of the primary expert's residual.

Weights come from Gram sums: one aggregate over the validation table gives k x k numbers per context value, and only
those reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridertide.config import TreeParams
from ridertide.functions.linalg import nonnegative_blend
from ridertide.functions.numeric import clip, finite, row_max, row_mean, row_min, row_std, total
from ridertide.operators.boosting import STATIC_FEATURES, STATISTIC_FEATURES, FittedTrees, fit_trees
from ridertide.operators.metrics import leaderboard
from ridertide.operators.ranking import exact_quantiles
from ridertide.operators.stumps import FittedStumps
from ridertide.sources.weather import WEATHER_FEATURES

CONTEXT = "hl_daylag"

# Context columns of the meta features.
STATION_META_CONTEXT = (
    "hl_daylag",
    "hour_sin",
    "hour_cos",
    "continuous_load_score",
    "local_slope_1",
    "local_slope_2",
    "daylag_deviation",
    "prev_count_ratio_daylag",
)
NETWORK_META_CONTEXT = (
    *STATION_META_CONTEXT,
    "roll_std_2",
    "roll_std_4",
    *STATISTIC_FEATURES,
    *STATIC_FEATURES,
    *WEATHER_FEATURES,
    "station_code",
    "line_code",
)


@dataclass
class Blend:
    """Weights per context value; the global weights serve where a context had too few rows."""

    models: list[str]
    overall: np.ndarray
    by_context: dict[int, np.ndarray]

    def _sum(self, weights: np.ndarray) -> Column:
        return total([F.lit(float(w)) * F.col(m) for m, w in zip(self.models, weights)])

    def static(self) -> Column:
        return self._sum(self.overall)

    def contextual(self) -> Column:
        high = self._sum(self.by_context[1])
        return F.when(F.coalesce(F.col(CONTEXT), F.lit(0)) == 1, high).otherwise(self._sum(self.by_context[0]))

    def weights(self, spark) -> DataFrame:
        """Weight table: context NULL for the overall weights."""
        rows = [(None, m, float(w)) for m, w in zip(self.models, self.overall)]
        rows += [(c, m, float(w)) for c, ws in self.by_context.items() for m, w in zip(self.models, ws)]
        return spark.createDataFrame(rows, "context int, model string, weight double")


def gram_sums(table: DataFrame, models: list[str], weight: Column | None = None) -> DataFrame:
    """Per context value: row count, X'X (upper half) and X'y, weighted if asked.

    Only rows with the target and every model's forecast count, so that all sums cover the same rows.
    """
    w = F.lit(1.0) if weight is None else weight
    x, y = [F.col(m) for m in models], F.col("y_true")
    pairs = [F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    moments = [F.sum(w * x[i] * y).alias(f"m{i}") for i in range(len(x))]
    context = F.coalesce(F.col(CONTEXT), F.lit(0)).alias("context")
    complete = table.dropna(subset=["y_true", *models])
    return complete.groupBy(context).agg(F.count(F.lit(1)).alias("n"), *pairs, *moments)


def require_forecasts(table: DataFrame, models: list[str]) -> None:
    """Stop if an expert has no finite forecast for an anchor; the error names the experts and folds."""
    gaps = [F.count_if(finite(F.col(m)).isNull()).alias(m) for m in models]
    rows = table.groupBy("fold").agg(*gaps).collect()  # one row per fold: two at most
    found = [f"{m} in fold {r['fold']}: {r[m]}" for r in sorted(rows, key=lambda r: str(r["fold"])) for m in models if r[m]]
    if found:
        raise ValueError("missing forecasts: " + "; ".join(found))


def fit_blend(table: DataFrame, models: list[str], least_rows: int, weight: Column | None = None) -> Blend:
    """Non-negative weights, overall and by context. A context under ``least_rows`` rows takes the overall ones."""
    k = len(models)
    sums = {}
    for row in gram_sums(table, models, weight).collect():  # one row per context value: two at most
        gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        sums[int(row["context"])] = (row["n"], gram, np.array([row[f"m{i}"] for i in range(k)]))
    if not sums:
        raise ValueError("no validation row has the target and all forecasts of the blend")
    overall = nonnegative_blend(sum(s[1] for s in sums.values()), sum(s[2] for s in sums.values()))
    by_context = {
        c: nonnegative_blend(sums[c][1], sums[c][2]) if c in sums and sums[c][0] >= least_rows else overall
        for c in (0, 1)
    }
    return Blend(models, overall, by_context)


def network_least_rows(models: list[str]) -> int:
    return max(30, 5 * len(models))


def station_least_rows(models: list[str]) -> int:
    return max(24, 6 * len(models))


def select_pool(metrics: DataFrame, baseline: str = "seasonal", tolerance: float = 1.05) -> list[str]:
    """Experts whose validation load-weighted MAE is within tolerance of the baseline's.

    The baseline always stays; with fewer than two left, the best three are taken.
    """
    rows = leaderboard(metrics, "lw_mae").select("model", "lw_mae").collect()  # one row per expert
    scores = {r["model"]: r["lw_mae"] for r in rows}
    if not scores:
        return []
    limit = tolerance * scores.get(baseline, min(scores.values()))
    chosen = [m for m, s in scores.items() if s <= limit]
    if baseline in scores and baseline not in chosen:
        chosen.append(baseline)
    return list(scores)[:3] if len(chosen) < min(2, len(scores)) else chosen


def meta_features(
    models: list[str], primary: str, context: list[str], extremes: bool = False
) -> dict[str, Column]:
    """Predictions, their differences to the primary, row statistics, and context with missing as 0.

    Only context is filled: a row that lacks a forecast keeps NULL there.
    """
    preds = [F.col(m).cast("double") for m in models]
    out = {f"pred_{m}": p for m, p in zip(models, preds)}
    for m, p in zip(models, preds):
        if m != primary:
            out[f"diff_{m}_minus_{primary}"] = p - F.col(primary)
            out[f"absdiff_{m}_{primary}"] = F.abs(p - F.col(primary))
    low, high = row_min(preds), row_max(preds)
    out["pred_mean"], out["pred_std"] = row_mean(preds), row_std(preds)
    if extremes:
        out["pred_min"], out["pred_max"] = low, high
    out["pred_range"] = high - low
    made = {n: finite(c) for n, c in out.items()}
    return {**made, **{c: F.coalesce(finite(F.col(c)), F.lit(0.0)) for c in context}}


def with_meta(table: DataFrame, features: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    """Meta features under ``meta_`` names, so that context columns keep their own values."""
    return table.withColumns({f"meta_{n}": c for n, c in features.items()}), [f"meta_{n}" for n in features]


@dataclass
class RidgeFit:
    features: list[str]
    coefficients: np.ndarray
    intercept: float

    def value(self) -> Column:
        return F.lit(self.intercept) + total([F.lit(float(b)) * F.col(f) for f, b in zip(self.features, self.coefficients)])

    def terms(self, spark) -> DataFrame:
        rows = [(f, float(b)) for f, b in zip(self.features, self.coefficients)]
        return spark.createDataFrame(rows, "feature string, coef double")


def fit_ridge(table: DataFrame, features: list[str], label: str, alpha: float, weight: str | None = None) -> RidgeFit:
    """Ridge with a free intercept and penalty ``alpha`` on the coefficients.

    Spark's least squares divides the loss by the total weight and scales the penalty by the label's deviation; the
    parameter passed in undoes both.
    """
    weighted = table.withColumn("fit_weight", F.lit(1.0) if weight is None else F.col(weight))
    known = weighted.filter(F.col(label).isNotNull())
    w, y = F.col("fit_weight"), F.col(label)
    ranges = [(F.max(f) - F.min(f)).alias(f"range_{i}") for i, f in enumerate(features)]
    size, mean, square, *widths = known.agg(
        F.sum(w), F.sum(w * y) / F.sum(w), F.sum(w * y * y) / F.sum(w), *ranges
    ).first()
    spread = max(square - mean * mean, 0.0) ** 0.5
    varying = [i for i, width in enumerate(widths) if width]
    coefficients = np.zeros(len(features))  # a constant feature keeps coefficient 0
    if spread == 0 or not varying:
        return RidgeFit(features, coefficients, float(mean))
    data = VectorAssembler(inputCols=[features[i] for i in varying], outputCol="ridge_in").transform(known)
    learner = LinearRegression(
        featuresCol="ridge_in",
        labelCol=label,
        weightCol="fit_weight",
        solver="normal",
        standardization=False,
        elasticNetParam=0.0,
        regParam=alpha / size * spread,
    )
    model = learner.fit(data.select("ridge_in", label, "fit_weight"))
    coefficients[varying] = model.coefficients.toArray()
    return RidgeFit(features, coefficients, float(model.intercept))


def residual_bounds(table: DataFrame, primary: str, probs: tuple[float, float]) -> tuple[float, float]:
    """Quantiles of the primary's validation residual."""
    low, high = exact_quantiles(table.select((F.col("y_true") - F.col(primary)).alias("residual")), "residual", list(probs))
    return low, high


def corrected(primary: str, correction: Column, bounds: tuple[float, float]) -> Column:
    """Primary forecast plus a correction kept within the residual quantiles."""
    return F.col(primary) + clip(correction, *bounds)


def with_residual(table: DataFrame, primary: str) -> DataFrame:
    return table.withColumn("residual", F.col("y_true") - F.col(primary))


def fit_residual_trees(
    table: DataFrame, features: list[str], params: TreeParams, seed: int, weight: str | None = None
) -> FittedTrees | FittedStumps:
    return fit_trees(table, features, "residual", params, seed, weight)


def direct_blend(
    validation: DataFrame, test: DataFrame, features: list[str], params: TreeParams, seed: int, name: str
) -> DataFrame:
    """Boosted trees straight from forecasts (and context) to the target."""
    return fit_trees(validation, features, "y_true", params, seed).add_prediction(test, name)


def importance_terms(trees: FittedTrees | FittedStumps, spark) -> DataFrame:
    """Importance per feature."""
    return spark.createDataFrame(list(trees.importances().items()), "feature string, importance double")
