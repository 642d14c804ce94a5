"""Forecast metrics.

Every metric is a ratio of sums, so predictions are reduced once to sums per group and all metrics (micro, macro,
and each bootstrap replicate) are computed from those sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridertide.functions.numeric import FLOOR

NETWORK_METRICS = ("mae", "rmse", "wmape", "lw_mae", "hl_mae", "hl_under_mae", "hl_under_rate")
STATION_METRICS = ("mae", "rmse", "wmape", "lw_mae")
NETWORK_SUMS = (
    "n",
    "sum_ae",
    "sum_se",
    "sum_abs_y",
    "sum_y",
    "sum_weighted",
    "sum_unscaled",
    "n_high",
    "sum_ae_high",
    "sum_under_high",
    "n_under_high",
)
STATION_SUMS = ("n", "sum_ae", "sum_se", "sum_abs_y", "sum_y", "sum_loaded")


def long_predictions(table: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    """One row per anchor and model: (keep..., model, pred)."""
    return table.unpivot(keep, models, "model", "pred")


def error_columns() -> tuple[Column, Column]:
    """(error y - pred, absolute error)."""
    error = F.col("y_true") - F.col("pred")
    return error, F.abs(error)


def _aggregates(terms: dict[str, str]) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in terms.items()]


def _powered(text: str, gamma: float) -> str:
    return f"({text})" if gamma == 1.0 else f"power({text}, {gamma}D)"


def network_sums(predictions: DataFrame, by: list[str], gamma: float) -> DataFrame:
    """Sums behind the network metrics.

    The load weight divides by the station's train mean. Where that mean is zero or missing the mean of the scored
    set takes its place; being one constant per set, it is divided out later, so its rows get a sum of their own.
    """
    scored = predictions.withColumns(
        {
            "error": F.expr("y_true - pred"),
            "ae": F.expr("abs(y_true - pred)"),
            "scale": F.expr("nullif(station_train_mean_target, 0D)"),
            "high": F.expr("coalesce(hl_actual, 0) = 1"),
        }
    )
    load = _powered(f"greatest(y_true, 0D) / greatest(scale, {FLOOR}D)", gamma)
    volume = _powered("greatest(y_true, 0D)", gamma)
    terms = {
        "n": "count(ae)",
        "sum_ae": "sum(ae)",
        "sum_se": "sum(error * error)",
        "sum_abs_y": "sum(abs(y_true))",
        "sum_y": "sum(y_true)",
        "sum_weighted": f"coalesce(sum(ae * {load}) FILTER (WHERE scale IS NOT NULL), 0D)",
        "sum_unscaled": f"coalesce(sum(ae * {volume}) FILTER (WHERE scale IS NULL), 0D)",
        "n_high": "count(ae) FILTER (WHERE high)",
        "sum_ae_high": "coalesce(sum(ae) FILTER (WHERE high), 0D)",
        "sum_under_high": "coalesce(sum(greatest(error, 0D)) FILTER (WHERE high), 0D)",
        "n_under_high": "count(ae) FILTER (WHERE high AND error > 0)",
    }
    return scored.groupBy(*by).agg(*_aggregates(terms))


def network_metrics(gamma: float) -> dict[str, Column]:
    """Metric expressions over the columns of ``network_sums``; NULL where a metric is undefined."""
    set_mean = _powered(f"greatest(sum_y / nullif(n, 0), {FLOOR}D)", gamma)
    texts = {
        "mae": "sum_ae / nullif(n, 0)",
        "rmse": "sqrt(sum_se / nullif(n, 0))",
        "wmape": "sum_ae / nullif(sum_abs_y, 0D)",
        "lw_mae": f"(sum_weighted + sum_unscaled / {set_mean}) / nullif(n, 0)",
        "hl_mae": "sum_ae_high / nullif(n_high, 0)",
        "hl_under_mae": "sum_under_high / nullif(n_high, 0)",
        "hl_under_rate": "n_under_high / nullif(n_high, 0)",
    }
    return {name: F.expr(text) for name, text in texts.items()}


def station_sums(predictions: DataFrame, by: list[str], gamma: float) -> DataFrame:
    """Sums behind the single-station metrics, whose load weight divides by the mean of the scored set."""
    scored = predictions.withColumn("ae", F.expr("abs(y_true - pred)"))
    terms = {
        "n": "count(ae)",
        "sum_ae": "sum(ae)",
        "sum_se": "sum(ae * ae)",
        "sum_abs_y": "sum(abs(y_true))",
        "sum_y": "sum(y_true)",
        "sum_loaded": f"sum(ae * {_powered('y_true', gamma)})",
    }
    return scored.groupBy(*by).agg(*_aggregates(terms))


def station_metrics(gamma: float) -> dict[str, Column]:
    """Metric expressions over the columns of ``station_sums``."""
    texts = {
        "mae": "sum_ae / nullif(n, 0)",
        "rmse": "sqrt(sum_se / nullif(n, 0))",
        "wmape": "sum_ae / nullif(sum_abs_y, 0D)",
        "lw_mae": f"sum_loaded / nullif(n, 0) / nullif({_powered('sum_y / nullif(n, 0)', gamma)}, 0D)",
    }
    return {name: F.expr(text) for name, text in texts.items()}


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


NETWORK_KEEP = ["station_key", "y_true", "hl_actual", "station_train_mean_target"]


def micro_metrics(table: DataFrame, models: list[str], gamma: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Network metrics over all rows, one row per model (and per ``by``)."""
    sums = network_sums(long_predictions(table, models, [*by, *NETWORK_KEEP]), [*by, "model"], gamma)
    return sums.select(*by, "model", *_named(network_metrics(gamma)))


def per_station_metrics(table: DataFrame, models: list[str], gamma: float = 1.0) -> DataFrame:
    sums = network_sums(long_predictions(table, models, NETWORK_KEEP), ["station_key", "model"], gamma)
    return sums.select("station_key", "model", *_named(network_metrics(gamma)))


def macro_metrics(table: DataFrame, models: list[str], gamma: float = 1.0) -> DataFrame:
    """Metrics per station, then their mean over the stations where they exist."""
    return per_station_metrics(table, models, gamma).groupBy("model").agg(*[F.avg(m).alias(m) for m in NETWORK_METRICS])


def series_metrics(table: DataFrame, models: list[str], gamma: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Single-station metrics, one row per model."""
    sums = station_sums(long_predictions(table, models, [*by, "y_true"]), [*by, "model"], gamma)
    return sums.select(*by, "model", *_named(station_metrics(gamma)))


def leaderboard(metrics: DataFrame, metric: str = "lw_mae") -> DataFrame:
    """Models in order of a metric, best first."""
    return metrics.orderBy(F.col(metric).asc_nulls_last(), "model")


def ranked(metrics: DataFrame, metric: str = "lw_mae") -> DataFrame:
    """Leaderboard position as a column. A metric table has one row per model, a few dozen at most."""
    order = Window.orderBy(F.col(metric).asc_nulls_last(), "model")
    return metrics.withColumn("position", F.row_number().over(order))


def best_model(metrics: DataFrame, metric: str = "lw_mae") -> str:
    return leaderboard(metrics, metric).first()["model"]


def top_models(metrics: DataFrame, metric: str, k: int) -> list[str]:
    return [r["model"] for r in leaderboard(metrics, metric).limit(k).collect()]


def top_terms(terms: DataFrame, value: str, n: int, by_size: bool = True) -> DataFrame:
    """Largest coefficients (by size) or importances (by value)."""
    key = F.abs(F.col(value)) if by_size else F.col(value)
    return terms.orderBy(key.desc(), "feature").limit(n)


def absolute_errors(table: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """Absolute error per anchor and model."""
    long = long_predictions(table, models, [*keys, "y_true"])
    return long.select(*keys, "model", error_columns()[1].alias("abs_error"))


def residual_corrections(table: DataFrame, primary: str, corrected: list[str]) -> DataFrame:
    """What each residual model adds to the primary model, per anchor."""
    return table.withColumns({f"{c}_correction": F.col(c) - F.col(primary) for c in corrected})


def blend_deltas(metrics: DataFrame, base: list[str], blends: list[str], by: str = "mae") -> DataFrame:
    """Improvement of each blend over the best base model: best base metric minus blend metric."""
    values = [c for c in STATION_METRICS if c in metrics.columns]
    best = metrics.filter(F.col("model").isin(*base)).agg(F.min_by(F.struct("model", *values), F.col(by)).alias("best"))
    reference = best.scalar()
    return metrics.filter(F.col("model").isin(*blends)).select(
        "model",
        reference["model"].alias("best_base"),
        *[(reference[c] - F.col(c)).alias(f"delta_{c}") for c in values],
    )


def busiest_station(table: DataFrame) -> DataFrame:
    """Station with the highest mean target."""
    means = table.groupBy("station_key").agg(F.avg("y_true").alias("mean_target"))
    return means.orderBy(F.col("mean_target").desc(), "station_key").limit(1)


def sweep_summary(boards: DataFrame, metric: str = "mae") -> DataFrame:
    """Best row of each configuration's leaderboard. Boards hold one row per configuration and model."""
    order = Window.partitionBy("config_name").orderBy(F.col(metric).asc_nulls_last(), "model")
    best = boards.withColumn("position", F.row_number().over(order)).filter("position = 1").drop("position")
    renamed = best.withColumnsRenamed({"model": "best_model", **{m: f"best_{m}" for m in STATION_METRICS}})
    return renamed.orderBy("horizon_minutes", "bucket_minutes", "config_name")
