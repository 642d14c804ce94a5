"""One-level trees by exhaustive split search.

Every distinct value of every feature is tried as a threshold, with missing values on either side. A row becomes one
(feature, value) pair per feature; pairs are tallied before they are shuffled, and the sums left of a threshold are
running sums over the sorted values. Values of a feature are cut into parts, so one feature with many values spreads
over many tasks: sums run inside the parts, and only one row per feature and part is summed up before them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridertide.functions.numeric import finite
from ridertide.session import stage

# Parts per feature, digits to which values and gains are compared, rounds after which the fitted values are staged.
PARTS, VALUE_DIGITS, GAIN_DIGITS, STAGE_ROUNDS = 32, 9, 6, 8
SUMS = ("n", "w", "s")


def feature_value(column: str) -> Column:
    """A feature's value, in which sums worked out in another order give the same number; missing if not finite."""
    return F.round(finite(F.col(column)), VALUE_DIGITS)


@dataclass(frozen=True)
class Stump:
    """Rows with feature <= threshold take ``left``; without a feature all rows take ``left``."""

    left: float
    right: float = 0.0
    feature: str | None = None
    threshold: float = 0.0
    missing_left: bool = False
    gain: float = 0.0

    def value(self) -> Column:
        if self.feature is None:
            return F.lit(self.left)
        x = feature_value(self.feature)
        return F.when(F.coalesce(x <= F.lit(self.threshold), F.lit(self.missing_left)), F.lit(self.left)).otherwise(F.lit(self.right))


def split_candidates(rows: DataFrame, columns: list[str], target: Column, weight: Column, min_rows: int) -> DataFrame:
    """(place of the feature, feature, threshold, missing_left, gain, left, right) of every split with ``min_rows`` rows
    on both sides. The gain is what the split takes off the weighted squared error."""
    clean = rows.select(target.alias("y"), weight.alias("weight"), *[feature_value(c).alias(c) for c in columns])
    long = clean.unpivot(["y", "weight"], columns, "feature", "value")
    w, y = F.col("weight"), F.col("y")
    tallied = long.groupBy("feature", "value").agg(F.count("y").alias("n"), F.sum(w).alias("w"), F.sum(w * y).alias("s"))
    tallied = stage(tallied)
    present = tallied.filter(F.col("value").isNotNull())

    # Tables with a row per feature (and part): a feature list has at most a few hundred names.
    shares = [i / PARTS for i in range(1, PARTS)]
    cuts = present.groupBy("feature").agg(F.percentile_approx("value", shares, 100 * PARTS).alias("cuts"))
    part = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    parted = present.join(F.broadcast(cuts), "feature").withColumn("part", part).drop("cuts")
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = parted.groupBy("feature", "part").agg(*[F.sum(c).alias(c) for c in SUMS])
    offsets = of_part.select("feature", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in SUMS])
    absent = F.col("value").isNull()
    totals = tallied.groupBy("feature").agg(
        *[F.sum(c).alias(f"all_{c}") for c in SUMS],
        *[F.coalesce(F.sum(F.when(absent, F.col(c))), F.lit(0)).alias(f"missing_{c}") for c in SUMS],
    )
    upto = Window.partitionBy("feature", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = parted.select("feature", "part", "value", *[F.sum(c).over(upto).alias(f"here_{c}") for c in SUMS])
    joined = running.join(F.broadcast(offsets), ["feature", "part"]).join(F.broadcast(totals), "feature")
    sides = joined.withColumn("missing_left", F.explode(F.array(F.lit(False), F.lit(True))))
    left = {c: F.col(f"before_{c}") + F.col(f"here_{c}") + F.when(F.col("missing_left"), F.col(f"missing_{c}")).otherwise(0) for c in SUMS}
    sides = sides.select(
        "feature",
        F.col("value").alias("threshold"),
        "missing_left",
        *[left[c].alias(f"left_{c}") for c in SUMS],
        *[(F.col(f"all_{c}") - left[c]).alias(f"right_{c}") for c in SUMS],
        (F.col("all_s") * F.col("all_s") / F.col("all_w")).alias("whole"),
    )
    kept = sides.filter((F.col("left_n") >= min_rows) & (F.col("right_n") >= min_rows) & (F.col("left_w") > 0) & (F.col("right_w") > 0))
    halves = [F.col(f"{side}_s") * F.col(f"{side}_s") / F.col(f"{side}_w") for side in ("left", "right")]
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature"))
    means = [(F.col(f"{side}_s") / F.col(f"{side}_w")).alias(side) for side in ("left", "right")]
    return kept.select(place.alias("place"), "feature", "threshold", "missing_left", (halves[0] + halves[1] - F.col("whole")).alias("gain"), *means)


def best_stump(rows: DataFrame, columns: list[str], target: Column, weight: Column, min_rows: int = 1) -> Stump:
    """The split with the largest gain; of equal ones (to ``GAIN_DIGITS`` digits) the first feature, then the smallest
    threshold, then missing values on the right. Without a possible split, the mean."""
    found = None
    if columns:
        candidates = split_candidates(rows, columns, target, weight, max(1, min_rows))
        order = [F.round("gain", GAIN_DIGITS).desc(), "place", "threshold", "missing_left"]
        found = candidates.orderBy(*order).first()
    if found is None:
        mean = rows.agg(F.sum(weight * target) / F.nullif(F.sum(weight), F.lit(0.0))).first()[0]
        return Stump(mean or 0.0)
    return Stump(found["left"], found["right"], found["feature"], found["threshold"], found["missing_left"], found["gain"])


@dataclass
class FittedStumps:
    """The first stump predicts the target, later ones the sign of what is left, each by ``step`` of the spread."""

    columns: list[str]
    stumps: list[Stump]
    step: float

    def value(self) -> Column:
        out = self.stumps[0].value()
        for stump in self.stumps[1:]:
            out = out + F.lit(self.step) * stump.value()
        return out

    def add_prediction(self, df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, self.value())

    def importances(self) -> dict[str, float]:
        """Share of each feature in all gains."""
        total = sum(s.gain for s in self.stumps if s.feature) or 1.0
        out = dict.fromkeys(self.columns, 0.0)
        for s in self.stumps:
            if s.feature:
                out[s.feature] += s.gain / total
        return out


def fit_stumps(
    train: DataFrame, columns: list[str], label: str, rounds: int, step: float, min_rows: int = 1, weight: str | None = None
) -> FittedStumps:
    """Boosted one-level trees on absolute error. Rows without a label are left out; none left is an error.

    Each round reads the training rows once. Steps are in units of the label's spread.
    """
    keep = dict.fromkeys([label, *columns] + ([weight] if weight else []))
    rows = train.filter(F.col(label).isNotNull()).select(*keep)
    size, spread = rows.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
    if not size:
        raise ValueError("no training row has a target")
    y, w = F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    fitted = FittedStumps(columns, [best_stump(rows, columns, y, w, min_rows)], step * (spread or 1.0))
    rows = rows.withColumn("fitted_value", fitted.stumps[0].value())
    for turn in range(1, rounds):
        if turn % STAGE_ROUNDS == 1:
            rows = stage(rows)
        side = F.when(y - F.col("fitted_value") >= 0, 1.0).otherwise(-1.0)
        stump = best_stump(rows, columns, side, w, min_rows)
        fitted.stumps.append(stump)
        rows = rows.withColumn("fitted_value", F.col("fitted_value") + F.lit(fitted.step) * stump.value())
    return fitted
