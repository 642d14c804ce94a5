"""Regular series from sparse counts, cut into time slices.

Window operators over a whole series put that series into one task. Here each series is cut into slices of a few
weeks, and a slice also carries the rows just before and after it (its halo) that window frames reach into. A window
over (series, slice) then gives the same values for the slice's own rows as one over the series, and a single long
series spreads over many tasks. Halo rows are dropped after the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series_bounds(counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """First and last step with events, per series. The filter keeps the column set equal to the count query's."""
    seen = F.when(F.col("count") > 0, F.col("step"))
    return counts.groupBy(*keys).agg(F.min(seen).alias("lo"), F.max(seen).alias("hi")).filter("lo IS NOT NULL")


def sliced_series(
    counts: DataFrame,
    keys: tuple[str, ...],
    span: int,
    back: int = 0,
    ahead: int = 0,
    within: tuple[int, int] | None = None,
) -> DataFrame:
    """(keys, slice, step, count) with every step of each series present, zero where nothing was counted.

    ``span`` is the slice length in steps; ``back`` and ``ahead`` are the halo sizes. ``within`` limits the result
    to a range of steps (the caller widens it by the halo). Grid rows and counts meet in one aggregate on
    (keys, slice, step) that is already partitioned the way the windows need, so there is one shuffle for both.
    """
    bounds = series_bounds(counts, keys)
    if within is not None:
        first, last = within
        counts = counts.filter(F.col("step").between(first, last))
        bounds = bounds.select(
            *keys, F.greatest("lo", F.lit(first)).alias("lo"), F.least("hi", F.lit(last)).alias("hi")
        ).filter("lo <= hi")
    slices = bounds.withColumn("slice", F.explode(F.sequence(_slice("lo", span), _slice("hi", span))))
    start = F.greatest(F.col("lo"), F.col("slice") * span - back)
    stop = F.least(F.col("hi"), (F.col("slice") + 1) * span - 1 + ahead)
    grid = slices.select(*keys, "slice", F.explode(F.sequence(start, stop)).alias("step"), F.lit(0.0).alias("count"))
    reach = F.sequence(F.floor((F.col("step") - ahead) / span), F.floor((F.col("step") + back) / span))
    copies = counts.select(*keys, F.explode(reach).alias("slice"), "step", "count")
    rows = grid.unionByName(copies).repartition(*keys, "slice")
    return rows.groupBy(*keys, "slice", "step").agg(F.sum("count").alias("count"))


def _slice(column: str, span: int):
    return F.floor(F.col(column) / F.lit(span))


def slice_window(keys: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*keys, "slice").orderBy("step")


def own_rows(sliced: DataFrame, span: int) -> DataFrame:
    """Drop the halo."""
    return sliced.filter(F.col("slice") == _slice("step", span)).drop("slice")


def dense_series(counts: DataFrame, keys: tuple[str, ...], span: int) -> DataFrame:
    """The complete series without halo: (keys, step, count)."""
    return sliced_series(counts, keys, span).drop("slice")
