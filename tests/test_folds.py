import datetime as dt

import numpy as np
import pytest
from helpers import counts_frame, step
from pyspark.sql import functions as F

from ridertide.config import NetworkConfig, StationConfig
from ridertide.operators import context, features, folds
from ridertide.operators.forecasts import aligned, anchors, seasonal_naive, unreached

CFG = NetworkConfig(bucket_minutes=60, horizon_minutes=180, line_codes=None)


def series(seed=3, late=False):
    rng = np.random.default_rng(seed)
    first = step("2024-01-01T00:00:00", 60)
    out = {}
    for key, offset, n in (("a", 0, 24 * 6), ("b", 10, 24 * 6), ("quiet", 0, 24 * 6), ("late", 60, 24 * 3)):
        values = rng.poisson(3.0, n).astype(float)
        if key == "quiet":
            values[:] = 0
        values[0] = values[-1] = 1
        out[key] = (first + offset, list(values))
    return out


@pytest.fixture(scope="module")
def built(spark):
    counts = counts_frame(spark, series()).cache()
    dates = folds.fold_dates(counts, CFG)
    frame = features.network_frame(counts, None, CFG)
    return counts, dates, folds.day_folds(frame, dates, CFG).cache()


def test_first_four_days_skip_the_sunday_night(built):
    # 00:00-02:59 on Monday belongs to Sunday, which the weekday filter leaves out.
    assert built[1] == [dt.date(2024, 1, d) for d in (1, 2, 3, 4)]


def test_dates_match_the_frame(spark, built):
    for weekdays in ((0, 1, 2, 3), (0, 2, 4, 6), (5, 6, 0, 1)):
        cfg = CFG.but(weekdays=weekdays)
        frame = features.network_frame(built[0], None, cfg)
        seen = sorted(r[0] for r in frame.filter(F.col("day_of_week").isin(*weekdays)).select("date").distinct().collect())
        if len(seen) < 4:
            with pytest.raises(ValueError, match="at least 4"):
                folds.fold_dates(built[0], cfg)
        else:
            assert folds.fold_dates(built[0], cfg) == seen[:4]


def test_fold_membership(built):
    rows = built[2].groupBy("fold", "role").agg(F.collect_set("date").alias("d")).collect()
    got = {(r["fold"], r["role"]): sorted(r["d"]) for r in rows}
    d = built[1]
    assert got == {("tune", "train"): d[:2], ("tune", "eval"): [d[2]], ("full", "train"): d[:3], ("full", "eval"): [d[3]]}


def test_pruned_range_gives_the_same_folds(built):
    counts, dates, whole = built
    within = folds.fold_range(dates, CFG)
    cut = folds.day_folds(features.network_frame(counts, None, CFG, within=within), dates, CFG)
    columns = whole.columns
    a = {tuple(r) for r in whole.select(*columns).collect()}
    assert a == {tuple(r) for r in cut.select(*columns).collect()}


def test_clip_per_day_and_per_segment(built):
    clipped = folds.clip_per_day(built[2], CFG)
    lost = built[2].count() - clipped.count()
    groups = built[2].select("fold", "role", "station_key", "date").distinct().count()
    assert lost == 3 * groups
    one = built[2].filter("station_key = 'a'")
    assert one.count() - folds.clip_per_segment(one, CFG).count() == 3 * 4
    assert clipped.filter("target_h is null").count() == 0


def test_context_uses_train_only_and_falls_back(built):
    clipped = folds.clip_per_day(built[2], CFG)
    table = context.attach_context(clipped, CFG).toPandas()
    train = table[(table.fold == "tune") & (table.role == "train")]
    q = train.groupby("station_key")["target_h"].quantile(0.8)
    for key in ("a", "b"):
        part = table[(table.fold == "tune") & (table.station_key == key)]
        assert part["station_train_q80_target"].iloc[0] == pytest.approx(q[key])
        assert ((part["target_h"] > q[key]).astype(int) == part["hl_actual"]).all()
    quiet = table[(table.station_key == "quiet") & (table.role == "eval")]
    assert (quiet["station_train_q80_target"] == 0).all() and quiet["q80_station"].isna().all()
    assert (quiet["hl_actual"] == 0).all() and quiet["continuous_load_score"].isna().all()
    late = table[(table.station_key == "late") & (table.fold == "tune")]
    assert len(late) and late["station_train_mean_target"].iloc[0] == pytest.approx(train["target_h"].mean())
    assert late["station_train_q80_target"].iloc[0] == pytest.approx(train["target_h"].quantile(0.8))


def test_normalized_scale(built):
    table = context.attach_context(folds.clip_per_day(built[2], CFG), CFG)
    scaled, names = context.normalize_scale(table, ["lag_1", "hour_sin", "target_daylag", "absent"])
    assert names == ["norm__lag_1", "hour_sin", "norm__target_daylag"]
    for r in scaled.limit(50).collect():
        assert r["station_scale"] == max(r["station_train_q80_target"], 1.0)
        if r["lag_1"] is not None:
            assert r["norm__lag_1"] == pytest.approx(r["lag_1"] / r["station_scale"])


def test_seasonal_fallbacks_and_expert_join(spark, built):
    table = anchors(context.attach_context(folds.clip_per_day(built[2], CFG), CFG))
    table = table.withColumn("seasonal", seasonal_naive(CFG))
    assert table.filter("seasonal is null").count() == 0
    late = table.filter("station_key = 'late' and fold = 'tune' and target_daylag is null").first()
    assert late["seasonal"] == pytest.approx(late["global_mean_target"])
    keys = ["fold", "station_key", "step"]
    some = table.filter("station_key = 'a'").select(*keys, F.lit(7.0).alias("pred"))
    joined = aligned(table, {"x": some}, keys, {"x": F.col("seasonal")})
    assert joined.count() == table.count()
    assert joined.filter("station_key = 'a' and x <> 7").count() == 0
    assert joined.filter("station_key <> 'a' and x <> seasonal").count() == 0
    assert unreached(table, some, keys).count() == table.filter("station_key <> 'a'").count()


def test_series_context(spark):
    values = list(np.random.default_rng(2).poisson(5, 24 * 6).astype(float) + 1)
    first = step("2024-01-01T00:00:00", 60)
    counts = spark.createDataFrame([(first + i, float(v)) for i, v in enumerate(values)], "step bigint, count double")
    cfg = StationConfig(bucket_minutes=60, horizon_minutes=180, context_features=("continuous_load_score",))
    dates = folds.fold_dates(counts, cfg, ())
    rows = folds.clip_per_segment(folds.day_folds(features.station_frame(counts, cfg), dates, cfg), cfg)
    table = context.attach_series_context(rows, cfg).toPandas()
    for fold in ("tune", "full"):
        part = table[table.fold == fold]
        q = part[part.role == "train"]["target_h"].quantile(0.8)
        assert part["q_train"].iloc[0] == pytest.approx(q)
        assert (part["hl_daylag"] == 0).all()
        assert ((part["target_h"] > q).astype(int) == part["hl_actual"]).all()
