"""Seasonal-naive forecast and the shared fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridertide.config import SeriesConfig
from ridertide.operators.folds import EVAL


def seasonal_naive(cfg: SeriesConfig, fallback: Column | None = None) -> Column:
    """Target one day earlier; else the count one day earlier; else the train mean of the fold."""
    mean = F.col("global_mean_target") if fallback is None else fallback
    return F.coalesce(F.col("target_daylag"), F.col(f"lag_{cfg.day_lag}"), mean)


def anchors(folds: DataFrame) -> DataFrame:
    """Evaluation rows, the target named ``y_true``."""
    return folds.filter(F.col("role") == EVAL).withColumnRenamed("target_h", "y_true")


def aligned(anchors_: DataFrame, found: dict[str, DataFrame], keys: list[str], fallbacks: dict[str, Column | None]) -> DataFrame:
    """The anchors with one forecast column per expert, and ``without``: the experts that did not reach the anchor.

    Anchors and the forecasts of all experts are stacked and meet in one aggregate on the key, so there is one exchange
    however many experts there are. An expert's fallback, if it has one, fills its gaps; forecasts of other rows than
    the anchors are left out. A key is one anchor, and an expert has one forecast for it.
    """
    own = [c for c in anchors_.columns if c not in keys]
    stacked = anchors_.select(*keys, F.struct(*own).alias("anchor"), F.lit(None).cast("string").alias("expert"), F.lit(None).cast("double").alias("pred"))
    for name, forecast in found.items():
        part = forecast.select(*keys, F.lit(name).alias("expert"), F.col("pred").cast("double").alias("pred"))
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    columns = [F.max(F.when(F.col("expert") == name, F.col("pred"))).alias(name) for name in found]
    wide = stacked.groupBy(*keys).agg(F.first("anchor", ignorenulls=True).alias("anchor"), *columns)
    wide = wide.filter(F.col("anchor").isNotNull())
    without = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in found]))
    out = wide.select(*keys, "anchor.*", *found, without.alias("without"))
    filled = {n: F.coalesce(F.col(n), c) for n, c in fallbacks.items() if n in found and c is not None}
    return out.withColumns(filled) if filled else out


def unreached(table: DataFrame, forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Anchors without a forecast of their own."""
    return table.select(*keys).join(forecasts.select(*keys), keys, "left_anti")
