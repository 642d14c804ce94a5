"""Dense ranks of distinct keys, and exact quantiles of a whole column."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridertide.session import stage

# Distinct values left when the search for quantiles ends, and parts that each step of it looks at.
LAST_VALUES, PARTS = 10_000, 64


def dense_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """(column, code): position of each distinct value in sorted order, from 0. NULL gets no code."""
    keys = df.select(column).filter(F.col(column).isNotNull())
    return range_codes(keys, column, code)


def add_codes(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """A dimension table with a dense code column per source column (``pairs``: source to code name).

    NULL is a value of its own and comes last.
    """
    kept = stage(df)
    codes = stage(sorted_codes(kept, list(pairs)))
    for which, (source, code) in enumerate(pairs.items()):
        own = codes.filter(F.col("which") == which).select(F.col(f"value_{which}").alias("coded_value"), F.col("code").alias(code))
        kept = kept.join(own, F.col(source).eqNullSafe(F.col("coded_value")), "left").drop("coded_value")
    return kept


def range_codes(keys: DataFrame, column: str, code: str) -> DataFrame:
    """Dense codes of the distinct values of one column, NULL last, without a single-task sort."""
    return sorted_codes(keys, [column]).select(F.col("value_0").alias(column), F.col("code").alias(code))


def sorted_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(which, value_0, value_1, ..., code): dense codes of the distinct values of several columns, NULL last.

    The values of all columns go through one range sort, as rows that hold a value of one column each. They are staged
    with their partition and place, so that neither can change on a retry. A code is the place inside the partition,
    less the rows of other columns before it, plus the rows of its own column in the partitions before; only those
    sizes, one per column and partition, go through one task.
    """
    values = [f"value_{i}" for i in range(len(columns))]
    kinds = {c: df.schema[c].dataType for c in columns}

    def only(which: int) -> Column:
        held = [F.col(c) if i == which else F.lit(None).cast(kinds[c]) for i, c in enumerate(columns)]
        named = [v.alias(n) for v, n in zip(held, values, strict=True)]
        return F.struct(F.lit(which).alias("which"), F.col(columns[which]).isNull().alias("missing"), *named)

    rows = df.select(F.inline(F.array(*[only(i) for i in range(len(columns))]))).distinct()
    placed = rows.orderBy("which", "missing", *values).select(
        "which",
        *values,
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"),
    )
    placed = stage(placed)
    sizes = placed.groupBy("part", "which").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("which").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy("part").orderBy("which").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum("size").over(w), F.lit(0)) for w in (earlier, beside)]
    offsets = sizes.select("part", "which", (sums[0] - sums[1]).alias("offset"))
    joined = placed.join(F.broadcast(offsets), ["part", "which"])
    return joined.select("which", *values, (F.col("offset") + F.col("place")).cast("int").alias("code"))


def exact_quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float | None]:
    """Exact linearly interpolated quantiles of one column in bounded memory.

    Values are tallied once; the ranks of all probabilities are then searched together.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    tallied = stage(values.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    whole = described(tallied.groupBy()).first()
    n = whole["rows"]
    if not n:
        return [None] * len(probs)
    ranks = [p * (n - 1) for p in probs]
    wanted = sorted({min(math.floor(r) + i, n - 1) for r in ranks for i in (0, 1)})
    found = values_at(tallied, wanted, Span(None, None, 0, n, whole["distinct"], tuple(whole["marks"])))
    out = []
    for rank in ranks:
        k = math.floor(rank)
        lower, upper = found[k], found[min(k + 1, n - 1)]
        out.append(lower if rank == k else lower + (upper - lower) * (rank - k))
    return out


@dataclass(frozen=True)
class Span:
    """Values low < v <= high, the rows before them, their own rows and distinct values, and marks that divide them."""

    low: float | None
    high: float | None
    below: int
    rows: int
    distinct: int
    marks: tuple[float, ...]

    def holds(self) -> Column:
        above = F.lit(True) if self.low is None else F.col("v") > self.low
        return above if self.high is None else above & (F.col("v") <= self.high)

    def has(self, ranks: list[int]) -> bool:
        return any(self.below <= k < self.below + self.rows for k in ranks)

    def cuts(self) -> list[float]:
        return sorted({m for m in self.marks if self.high is None or m < self.high})

    def parts(self, found: dict[int, tuple]) -> list[Span]:
        """The spans between the cuts, from (rows, distinct, marks) of each."""
        cuts, below, out = self.cuts(), self.below, []
        for i, (low, high) in enumerate(zip([self.low, *cuts], [*cuts, self.high], strict=True)):
            if i in found:
                out.append(Span(low, high, below, *found[i]))
                below += found[i][0]
        return out


def described(grouped) -> DataFrame:
    shares = [i / PARTS for i in range(1, PARTS)]
    marks = F.percentile_approx("v", shares, 100 * PARTS).alias("marks")
    return grouped.agg(F.sum("n").alias("rows"), F.count("v").alias("distinct"), marks)


def values_at(tallied: DataFrame, ranks: list[int], whole: Span) -> dict[int, float]:
    """The values at ascending ranks, counted from 0, of values v that occur n times.

    Each pass divides all spans that hold a wanted rank and keeps the parts that do; it tallies them and finds the next
    marks in one job. The number of passes depends on the number of values, not on the number of ranks. When few
    values are left in all spans together, they are read.
    """
    spans = [whole]
    while sum(s.distinct for s in spans) > LAST_VALUES and any(s.cuts() for s in spans):
        where = F.lit(None).cast("struct<span:int,part:int>")
        for i, s in enumerate(spans):
            part = F.size(F.filter(F.array(*[F.lit(c) for c in s.cuts()]), lambda c: c < F.col("v"))) if s.cuts() else F.lit(0)
            where = F.when(s.holds(), F.struct(F.lit(i).alias("span"), part.alias("part"))).otherwise(where)
        inside = tallied.withColumn("where", where).filter(F.col("where").isNotNull())
        found: dict[int, dict[int, tuple]] = {}
        for r in described(inside.groupBy("where")).collect():  # a row per span and part
            found.setdefault(r["where"]["span"], {})[r["where"]["part"]] = (r["rows"], r["distinct"], tuple(r["marks"]))
        spans = [p for i, s in enumerate(spans) for p in s.parts(found[i]) if p.has(ranks)]
    left = tallied.filter(F.array_contains(F.array(*[s.holds() for s in spans]), True)).select("v", "n")
    rows = sorted((r["v"], r["n"]) for r in left.collect())  # LAST_VALUES at most
    out: dict[int, float] = {}
    for s in spans:
        below = s.below
        for v, n in rows:
            if (s.low is None or v > s.low) and (s.high is None or v <= s.high):
                out.update({k: v for k in ranks if below <= k < below + n})
                below += n
    return out
