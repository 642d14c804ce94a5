"""Bootstrap intervals from sums.

Resampling rows would build replicates x rows x models rows. All metrics are ratios of sums, so a replicate only
needs to know how often each station (or which blocks) were drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridertide.functions.draws import draw
from ridertide.functions.numeric import power
from ridertide.operators.metrics import (
    NETWORK_KEEP,
    NETWORK_METRICS,
    NETWORK_SUMS,
    STATION_METRICS,
    STATION_SUMS,
    error_columns,
    long_predictions,
    network_metrics,
    network_sums,
    series_metrics,
    station_metrics,
)
from ridertide.operators.ranking import dense_codes


def _replicates(n_boot: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))


def station_draws(table: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(rep, station_key, times): how often each replicate drew each station, as many draws as stations."""
    codes = dense_codes(table, "station_key", "code")
    size = codes.agg(F.count(F.lit(1))).scalar()
    draws = codes.select(_replicates(n_boot).alias("rep"), F.col("code").alias("position"))
    drawn = draws.select("rep", draw(F.col("rep"), F.col("position"), seed, size).alias("code"))
    times = drawn.groupBy("rep", "code").agg(F.count(F.lit(1)).alias("times"))
    return times.join(codes, "code").select("rep", "station_key", "times")


def _station_parts(table: DataFrame, models: list[str], gamma: float) -> DataFrame:
    """Per station and model, the sums and the station's own metrics."""
    sums = network_sums(long_predictions(table, models, NETWORK_KEEP), ["station_key", "model"], gamma)
    return sums.select("*", *[c.alias(f"own_{m}") for m, c in network_metrics(gamma).items()])


def _combined(parts: DataFrame, by: list[str], times: str, gamma: float, value: str) -> DataFrame:
    """(by..., mode, metric, value): micro from weighted sums, macro as the mean of the stations' own metrics."""
    weighted = [F.expr(f"sum({s} * {times})").alias(s) for s in NETWORK_SUMS]
    averaged = [F.expr(f"avg(own_{m})").alias(f"own_{m}") for m in NETWORK_METRICS]
    totals = parts.groupBy(*by).agg(*weighted, *averaged)
    scores = [("micro", m, c) for m, c in network_metrics(gamma).items()]
    scores += [("macro", m, F.col(f"own_{m}")) for m in NETWORK_METRICS]
    rows = [F.struct(F.lit(g).alias("mode"), F.lit(m).alias("metric"), c.alias(value)) for g, m, c in scores]
    return totals.select(*by, F.inline(F.array(*rows)))


def station_replicates(
    table: DataFrame, models: list[str], n_boot: int, seed: int, gamma: float = 1.0
) -> DataFrame:
    """Metric values per replicate: (rep, model, mode, metric, value).

    Micro counts a station as often as it was drawn. Macro averages over the distinct drawn stations: repeats of a
    station fall into one group there and leave its metrics unchanged.
    """
    drawn = station_draws(table, n_boot, seed).join(_station_parts(table, models, gamma), "station_key")
    return _combined(drawn, ["rep", "model"], "times", gamma, "value")


def station_estimates(table: DataFrame, models: list[str], gamma: float = 1.0) -> DataFrame:
    """Point values: (model, mode, metric, estimate)."""
    return _combined(_station_parts(table, models, gamma), ["model"], "1", gamma, "estimate")


def block_replicates(
    table: DataFrame, models: list[str], order: str, n_boot: int, block: int, seed: int, gamma: float = 1.0
) -> DataFrame:
    """Moving-block replicates of one scored series: (rep, model, metric, value).

    Blocks of consecutive anchors are drawn until the series length is reached; the last block is cut. Each block's
    sums are the difference of two running totals, so replicates cost blocks, not rows. The scored series is one
    operating day.
    """
    complete = table.dropna(subset=["y_true", *models])
    long = long_predictions(complete, models, [order, "y_true"])
    error, ae = error_columns()
    terms = {
        "n": F.lit(1),
        "sum_ae": ae,
        "sum_se": error * error,
        "sum_abs_y": F.abs(F.col("y_true")),
        "sum_y": F.col("y_true"),
        "sum_loaded": ae * power(F.col("y_true"), gamma),
    }
    w = Window.partitionBy("model").orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    running = long.select("model", F.row_number().over(w).alias("place"), *[F.sum(c).over(upto).alias(n) for n, c in terms.items()])
    size = complete.count()
    if not size:
        raise ValueError("cannot bootstrap an empty scored set")
    block = max(1, min(block, size))
    n_blocks = -(-size // block)
    spark = table.sparkSession
    reps = spark.range(n_boot).withColumnRenamed("id", "rep")
    blocks = reps.select("rep", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    start = draw(F.col("rep"), F.col("block"), seed, F.lit(size - block + 1))
    length = F.least(F.lit(block), F.lit(size) - F.col("block") * block)
    spans = blocks.select("rep", start.alias("before"), (start + length).alias("place"))
    zero = long.select("model").distinct().select("model", F.lit(0).alias("place"), *[F.lit(0.0).alias(n) for n in STATION_SUMS])
    marks = running.unionByName(zero)
    ends = spans.join(marks, "place").select("rep", "model", *[F.col(n).cast("double") for n in STATION_SUMS])
    starts = spans.drop("place").withColumnRenamed("before", "place").join(marks, "place")
    starts = starts.select("rep", "model", *[(-F.col(n)).cast("double").alias(n) for n in STATION_SUMS])
    totals = ends.unionByName(starts).groupBy("rep", "model").agg(*[F.sum(n).alias(n) for n in STATION_SUMS])
    values = totals.select("rep", "model", *[c.alias(m) for m, c in station_metrics(gamma).items()])
    return values.unpivot(["rep", "model"], list(STATION_METRICS), "metric", "value")


def block_estimates(table: DataFrame, models: list[str], gamma: float = 1.0) -> DataFrame:
    complete = table.dropna(subset=["y_true", *models])
    return series_metrics(complete, models, gamma).unpivot(["model"], list(STATION_METRICS), "metric", "estimate")


def _bounds(value: str, alpha: float) -> list[Column]:
    """A group holds one value per replicate."""
    ends = F.percentile(value, [alpha / 2, 1 - alpha / 2])
    return [ends[0].alias("ci_low"), ends[1].alias("ci_high")]


def metric_intervals(replicates: DataFrame, estimates: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Estimate and interval per (mode,) model and metric."""
    keys = [c for c in ("mode", "model", "metric") if c in estimates.columns]
    ends = replicates.groupBy(*keys).agg(*_bounds("value", alpha))
    return estimates.join(ends, keys, "left").select(*keys, "estimate", "ci_low", "ci_high")


def delta_intervals(
    replicates: DataFrame, estimates: DataFrame, baselines: list[str], alpha: float = 0.05
) -> DataFrame:
    """Paired improvement over each baseline (baseline metric minus model metric), its interval, and whether the
    interval leaves out zero."""
    shared = [c for c in ("mode", "metric") if c in estimates.columns]

    def paired(df: DataFrame, value: str, extra: list[str]) -> DataFrame:
        # A group holds one score per model.
        scores = F.collect_list(F.struct("model", F.col(value).alias("value"))).alias("scores")
        grouped = df.groupBy(*extra, *shared).agg(scores)
        base = F.explode(F.filter("scores", lambda x: x["model"].isin(*baselines))).alias("base")
        both = grouped.select(*extra, *shared, "scores", base)
        both = both.select(*extra, *shared, "base", F.explode("scores").alias("own"))
        both = both.filter(F.col("own.model") != F.col("base.model"))
        delta = F.col("base.value") - F.col("own.value")
        names = [F.col("base.model").alias("baseline"), F.col("own.model").alias("model")]
        return both.select(*extra, *shared, *names, delta.alias("delta"))

    keys = [*shared, "baseline", "model"]
    ends = paired(replicates, "value", ["rep"]).groupBy(*keys).agg(*_bounds("delta", alpha))
    points = paired(estimates, "estimate", []).select(*keys, F.col("delta").alias("delta_estimate"))
    clear = F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False))
    return points.join(ends, keys, "left").withColumn("significant_95", clear)


def selected_deltas(deltas: DataFrame, mode: str, baselines: list[str], names: list[str]) -> DataFrame:
    """The rows of a delta table worth reporting, best improvement first within baseline and metric."""
    wanted = (F.col("mode") == mode) & F.col("baseline").isin(*baselines) & F.col("metric").isin(*names)
    return deltas.filter(wanted).orderBy("baseline", "metric", F.col("delta_estimate").desc())
