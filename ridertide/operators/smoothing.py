"""Local additive Holt-Winters per station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridertide.config import SeriesConfig
from ridertide.operators.folds import EVAL, TRAIN

# Smoothing constants tried per series; the set with the least squared one-step error is used.
LEVELS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
TRENDS = (0.0, 0.01, 0.05, 0.1)
SEASONS = (0.0, 0.05, 0.1, 0.2, 0.4)
CONSTANTS = [(a, b, c) for a in LEVELS for b in TRENDS for c in SEASONS]
# Digits to which errors are compared; of equal ones the first constants are used.
DIGITS = 9


def let(value: Column, body) -> Column:
    """``body`` of a value that it uses several times but that is worked out once."""
    return F.transform(F.array(value), body)[0]


def smoothed(counts: Column, start: Column, constants: Column) -> Column:
    """The state after all counts: level, trend, the seasons to come (nearest first) and the squared error so far."""

    def step(state: Column, y: Column) -> Column:
        season = state["seasons"][0]
        plain = state["level"] + state["trend"]
        level = constants["a"] * (y - season) + (1 - constants["a"]) * plain

        def moved(raised: Column) -> Column:
            error = y - state["level"] - state["trend"] - season
            trend = constants["b"] * (raised - state["level"]) + (1 - constants["b"]) * state["trend"]
            renewed = constants["c"] * (y - raised) + (1 - constants["c"]) * season
            rest = F.slice(state["seasons"], F.lit(2), F.size(state["seasons"]))
            return F.struct(
                raised.alias("level"),
                trend.alias("trend"),
                F.concat(rest, F.array(renewed)).alias("seasons"),
                (state["cost"] + error * error).alias("cost"),
            )

        return let(level, moved)

    return F.aggregate(counts, start, step)


def holt_winters(folds: DataFrame, cfg: SeriesConfig, keys: tuple[str, ...] = ("station_key",), floor: bool = True) -> DataFrame:
    """Next-horizon sums of a forecast count path: (fold, keys..., step, pred).

    Trained on the train days of a fold and run over its evaluation day (rows before the horizon clip). A group is
    one station in one fold, at most four days of buckets, so its arrays do not grow with event volume. The recursion
    is a fold over the ordered counts, once for each set of constants and once more for the best. Series under two
    days, or with missing counts, give no rows.
    """
    day, horizon = cfg.day_lag, cfg.horizon_steps
    part = lambda role, *values: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct(*values))))
    count = F.col("count").cast("double").alias("count")
    series = folds.groupBy("fold", *keys).agg(part(TRAIN, "step", count).alias("train"), part(EVAL, "step").alias("ahead"))
    series = series.select(
        "fold", *keys, F.transform("train", lambda x: x["count"]).alias("counts"), F.transform("ahead", lambda x: x["step"]).alias("ahead")
    )
    known = ~F.exists("counts", lambda x: x.isNull() | F.isnan(x))
    usable = series.filter((F.size("counts") >= 2 * day) & known & (F.size("ahead") > horizon))

    def mean(first: int) -> Column:
        return F.aggregate(F.slice("counts", first, day), F.lit(0.0), lambda a, x: a + x) / F.lit(float(day))

    placed = usable.withColumns({"first": mean(1), "second": mean(day + 1)})
    start = F.struct(
        F.col("first").alias("level"),
        ((F.col("second") - F.col("first")) / F.lit(float(day))).alias("trend"),
        F.transform(F.slice("counts", 1, day), lambda x: x - F.col("first")).alias("seasons"),
        F.lit(0.0).alias("cost"),
    )
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in CONSTANTS])
    started = placed.select("fold", *keys, "counts", "ahead", start.alias("start"), grid.alias("grid"))
    tried = F.transform(
        "grid",
        lambda c, i: F.struct(F.round(smoothed(F.col("counts"), F.col("start"), c)["cost"], DIGITS).alias("cost"), i.alias("place")),
    )
    best = F.element_at("grid", F.array_min(tried)["place"] + 1)
    fitted = started.withColumn("best", best)
    fitted = fitted.withColumn("state", smoothed(F.col("counts"), F.col("start"), F.col("best"))).drop("start", "grid")

    def ahead_by(k: Column) -> Column:
        season = F.element_at(F.col("state.seasons"), F.pmod(k - 1, F.lit(day)).cast("int") + 1)
        value = F.col("state.level") + k * F.col("state.trend") + season
        return F.greatest(value, F.lit(0.0)) if floor else value

    path = F.transform(F.sequence(F.lit(1), F.size("ahead")), ahead_by)
    paths = fitted.select("fold", *keys, "ahead", path.alias("path"))
    reached = F.slice("ahead", F.lit(1), F.size("ahead") - horizon)
    each = paths.select("fold", *keys, "path", F.posexplode(reached).alias("place", "step"))
    total = F.aggregate(F.slice("path", F.col("place") + 2, F.lit(horizon)), F.lit(0.0), lambda a, x: a + x)
    return each.select("fold", *keys, "step", total.alias("pred"))
