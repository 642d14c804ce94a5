"""Load context: statistics learned on the train part of a fold, applied to both parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridertide.config import NetworkConfig, StationConfig
from ridertide.functions.numeric import FLOOR, clip, finite, flag, load_weight, ratio
from ridertide.operators.folds import TRAIN
from ridertide.operators.ranking import exact_quantiles

# Names of the statistics.
STATION_STATS = (
    "station_train_mean_target",
    "station_train_median_target",
    "station_train_q80_target",
    "station_train_q95_target",
    "station_train_max_target",
    "station_train_mean_count",
)
RELATIVE_STATS = (
    ("station_mean_target_vs_global", "station_train_mean_target"),
    ("station_q80_target_vs_global", "station_train_q80_target"),
    ("station_mean_count_vs_global", "station_train_mean_count"),
)


def _train(folds: DataFrame) -> DataFrame:
    return folds.filter(F.col("role") == TRAIN)


def station_stats(folds: DataFrame, cfg: NetworkConfig) -> DataFrame:
    """Per fold and station: mean, median, high-load quantile, q95 and max of the target, and mean count.

    Quantiles are exact; a station has at most three train days, so a group is small whatever the event volume.
    """
    points = F.percentile("target_h", [0.5, cfg.highload_quantile, 0.95])
    stats = _train(folds).groupBy("fold", "station_key").agg(
        F.avg("target_h").alias("station_train_mean_target"),
        points.alias("points"),
        F.max("target_h").alias("station_train_max_target"),
        F.avg("count").alias("station_train_mean_count"),
    )
    return stats.select(
        "fold",
        "station_key",
        "station_train_mean_target",
        F.col("points")[0].alias("station_train_median_target"),
        F.col("points")[1].alias("station_train_q80_target"),
        F.col("points")[2].alias("station_train_q95_target"),
        "station_train_max_target",
        "station_train_mean_count",
    )


def global_stats(folds: DataFrame, cfg: NetworkConfig) -> DataFrame:
    """The same set over all stations: one row per fold.

    Targets are whole numbers, so they are counted per distinct value first and the quantile works on those counts.
    """
    tallied = (
        _train(folds)
        .groupBy("fold", "target_h")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("count_sum"))
    )
    known = F.col("target_h").isNotNull()
    weighted = F.when(known, F.col("n"))
    points = F.percentile("target_h", [0.5, cfg.highload_quantile, 0.95], F.coalesce(weighted, F.lit(0)))
    stats = tallied.groupBy("fold").agg(
        (F.sum(F.col("target_h") * F.col("n")) / F.sum(weighted)).alias("global_mean_target"),
        points.alias("points"),
        F.max("target_h").alias("global_max_target"),
        (F.sum("count_sum") / F.sum("n")).alias("global_mean_count"),
    )
    return stats.select(
        "fold",
        "global_mean_target",
        F.col("points")[0].alias("global_median_target"),
        F.col("points")[1].alias("global_q80_target"),
        F.col("points")[2].alias("global_q95_target"),
        "global_max_target",
        "global_mean_count",
    )


def _global_name(stat: str) -> str:
    return stat.replace("station_train_", "global_")


def load_columns(threshold: Column) -> dict[str, Column]:
    """High-load flags and load score against a threshold; a threshold of zero counts as missing."""
    usable = F.nullif(threshold, F.lit(0.0))
    return {
        "q80_station": usable,
        "hl_daylag": flag(F.col("target_daylag") > usable),
        "hl_actual": flag(F.col("target_h") > usable),
        "continuous_load_score": F.col("target_daylag") / usable,
    }


def known_or_stop(statistic: Column) -> Column:
    """A statistic of a fold's train targets, or an error that names the fold."""
    message = F.concat(F.lit("no train target in fold "), F.col("fold"))
    return F.when(statistic.isNotNull(), statistic).otherwise(F.raise_error(message).cast("double"))


def attach_context(folds: DataFrame, cfg: NetworkConfig) -> DataFrame:
    """Station statistics with global fallback, high-load flags, and ratios to the network.

    A fold without a train target is an error.
    """
    overall = F.broadcast(global_stats(folds, cfg))  # one row per fold: two at most
    joined = folds.join(station_stats(folds, cfg), ["fold", "station_key"], "left").join(overall, "fold", "left")
    joined = joined.withColumn("global_mean_target", known_or_stop(F.col("global_mean_target")))
    filled = joined.withColumns({s: F.coalesce(F.col(s), F.col(_global_name(s))) for s in STATION_STATS})
    filled = filled.withColumns(load_columns(F.col("station_train_q80_target")))
    relative = {
        name: F.col(stat) / F.greatest(F.col(_global_name(stat)), F.lit(FLOOR)) for name, stat in RELATIVE_STATS
    }
    return filled.withColumns(relative)


def attach_series_context(folds: DataFrame, cfg: StationConfig) -> DataFrame:
    """Single-station context: one threshold per fold. A fold holds at most three train days of one series.

    A fold without a train target is an error.
    """
    thresholds = _train(folds).groupBy("fold").agg(F.percentile("target_h", cfg.highload_quantile).alias("q_train"))
    joined = folds.join(F.broadcast(thresholds), "fold", "left")  # one row per fold: two at most
    joined = joined.withColumn("q_train", known_or_stop(F.col("q_train")))
    limit = F.col("q_train")
    columns = {"hl_actual": flag(F.col("target_h") > limit)}
    on_daylag = flag(F.col("target_daylag") > limit)
    columns["hl_daylag"] = on_daylag if "highload_daylag" in cfg.context_features else F.lit(0)
    if "continuous_load_score" in cfg.context_features:
        columns["continuous_load_score"] = ratio(F.col("target_daylag"), limit)
    return joined.withColumns(columns)


def sample_weight(y: Column, mean: Column, typical: Column, gamma: float) -> Column:
    """Training weight by load, kept within [0.25, 8]; ``typical`` stands in for a missing or zero mean."""
    known = finite(mean)
    usable = F.coalesce(F.when(known > 0, known), typical, F.lit(1.0))
    return F.coalesce(clip(load_weight(y, usable, gamma), 0.25, 8.0), F.lit(1.0))


def median_station_mean(table: DataFrame) -> float | None:
    """Median of the positive station means over all rows of a table."""
    return exact_quantiles(table.filter(F.col("station_train_mean_target") > 0), "station_train_mean_target", [0.5])[0]


# Statistics that may scale a station, in order of preference, and the columns that are scaled.
SCALE_SOURCES = (
    "station_train_q80_target",
    "q80_station",
    "station_train_mean_target",
    "station_train_median_target",
    "station_train_mean_count",
)
MAGNITUDE_PREFIXES = ("lag_", "roll_sum_", "roll_mean_")
MAGNITUDE_COLUMNS = ("target_daylag",)


def is_magnitude(column: str) -> bool:
    return column in MAGNITUDE_COLUMNS or column.startswith(MAGNITUDE_PREFIXES)


def normalize_scale(table: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Volume-like features and the target divided by a station scale of at least 1.

    Returns the table with ``station_scale``, ``target_norm`` and ``norm__*`` columns, and the new feature list. The
    scale is the first known statistic of the station, else the median scale of its fold and role.
    """
    sources = [finite(F.col(c)) for c in SCALE_SOURCES if c in table.columns]
    scaled = table.withColumn("own_scale", F.coalesce(*sources) if sources else F.lit(None).cast("double"))
    tallied = scaled.groupBy("fold", "role", "own_scale").agg(F.count(F.lit(1)).alias("n"))
    tallied = tallied.filter(F.col("own_scale").isNotNull())
    typical = tallied.groupBy("fold", "role").agg(F.percentile("own_scale", 0.5, F.col("n")).alias("typical_scale"))
    # typical: one row per fold and role, four at most
    joined = scaled.join(F.broadcast(typical), ["fold", "role"], "left")
    scale = F.greatest(F.coalesce("own_scale", "typical_scale", F.lit(1.0)), F.lit(1.0))
    joined = joined.withColumn("station_scale", scale).drop("own_scale", "typical_scale")
    kept = [c for c in features if c in table.columns]
    divided = {f"norm__{c}": F.col(c).cast("double") / F.col("station_scale") for c in kept if is_magnitude(c)}
    divided["target_norm"] = F.col("target_h") / F.col("station_scale")
    return joined.withColumns(divided), [f"norm__{c}" if is_magnitude(c) else c for c in kept]
