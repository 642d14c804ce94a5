"""Whole runs from raw files."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridertide.config import NetworkConfig, StationConfig, TreeParams
from ridertide.operators.metrics import NETWORK_METRICS
from ridertide.operators.stations import map_profile
from ridertide.plans import maps, network, station
from ridertide.sources.events import read_events_csv
from ridertide.sources.places import read_places, read_plain_places
from ridertide.sources.tables import read_buckets, write_buckets

FEW = (TreeParams(3, 0.3, 2),)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Five days of taps at six places of four stations on two lines."""
    folder = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1, 3)
    lines = ["TRAN_DATE;TRANSPORT_TYPE_ID;PLACE_ID;VALIDATION_MODE;APP_ID"]
    for hour in range(24 * 5):
        for place in range(1, 7):
            level = 2 + place * (1 + np.sin(2 * np.pi * hour / 24))
            for _ in range(rng.poisson(level) + (hour == 0)):
                at = start + dt.timedelta(hours=hour, seconds=int(rng.integers(0, 3600)))
                lines.append(f"{at};1;{place};1;x")
    (folder / "taps.csv").write_text("\n".join(lines) + "\n")
    rows = ["PLACE_ID;TYPE_ID;ST_CODE;ST_NAME;LN_CODE;LN_NAME"]
    rows += [f"{p};1;{p // 2};S{p // 2};{8 + p % 2};L{8 + p % 2}" for p in range(1, 7)]
    (folder / "REF_1.csv").write_text("\n".join(rows) + "\n")
    return folder


def test_network_run(spark, files, tmp_path):
    cfg = NetworkConfig(
        bucket_minutes=60, horizon_minutes=180, tree_grid=FEW, residual_trees=TreeParams(3, 0.3, 2), n_bootstrap=30, top_k=1
    )
    counts, stations, buckets = network.prepare_network(spark, str(files / "taps.csv"), str(files), "REF_*.csv", cfg)
    write_buckets(buckets, str(tmp_path / "buckets"), ["LN_CODE", "ST_CODE", cfg.time_col])
    result = network.run_from_buckets(read_buckets(spark, str(tmp_path / "buckets")), stations, cfg)
    assert set(result.models) == {*network.EXPERTS, *network.BLENDS, *network.RESIDUALS}
    n = result.stations.count()
    assert result.test().count() == result.validation().count() == n * 21
    gaps = result.predictions.select(*[F.count(F.when(F.col(m).isNull(), 1)).alias(m) for m in result.models]).first()
    assert sum(gaps) == 0
    micro = {r["model"]: r for r in result.micro.collect()}
    assert micro["sequence"]["mae"] < 1.5 * micro["seasonal"]["mae"]
    assert "seasonal" in result.pool and result.primary in result.pool
    assert result.blend.overall.sum() == pytest.approx(1.0)
    assert result.metric_ci.count() == 2 * len(result.models) * len(NETWORK_METRICS)
    bad = result.metric_ci.filter("ci_low > ci_high").count()
    assert bad == 0 and result.macro.count() == len(result.models)
    baselines = {r[0] for r in result.delta_ci.select("baseline").distinct().collect()}
    assert baselines == set(network.EXPERTS) - {"sequence"}
    assert len(result.terms) == 4
    scores = result.candidates.collect()
    assert {r["expert"] for r in scores} == {m for m in network.EXPERTS if m.startswith("trees")}
    assert all(sum(r["chosen"] for r in scores if r["expert"] == m) == cfg.top_k for m in {r["expert"] for r in scores})
    assert {r["expert"] for r in result.fallbacks.collect()} <= {"smoothing", "sequence"}
    paths = network.save_network(result, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(paths["test_predictions"]).count() == n * 21


def test_weather_of_a_run(spark, tmp_path):
    cfg = NetworkConfig(bucket_minutes=60, horizon_minutes=180)
    assert network.network_weather(spark, cfg) is None
    assert network.network_weather(spark, cfg.but(weather_path=str(tmp_path / "none.csv"))) is None
    (tmp_path / "w.csv").write_text("time,rain\n2024-01-01 03:20:00,1.5\n2024-01-01 03:40:00,2.5\nbad,9\n")
    rows = network.network_weather(spark, cfg.but(weather_path=str(tmp_path / "w.csv"))).collect()
    assert [(str(r["weather_hour"]), r["weather_rain"]) for r in rows] == [("2024-01-01 03:00:00", 2.5)]
    (tmp_path / "x.csv").write_text("time,rain\nbad,9\n")
    with pytest.raises(ValueError, match="no weather timestamp"):
        network.network_weather(spark, cfg.but(weather_path=str(tmp_path / "x.csv")))


def test_station_run_and_sweep(spark, files, tmp_path):
    cfg = StationConfig(
        name="h3", bucket_minutes=60, horizon_minutes=180, place_ids=(5, 6), tree_grid=FEW, run_direct=True,
        day_start_hour=3, meta_trees=TreeParams(3, 0.3, 1), n_bootstrap=30, top_k=1, sequence_in_residual=True,
        lag_minutes=(60, 120, 1440, 1500), rolling_minutes=(120, 180), 
    )
    taps = station.station_taps(spark, str(files / "taps.csv"), cfg)
    assert {r[0] for r in taps.select("PLACE_ID").distinct().collect()} == {5, 6}
    summary, results = station.run_sweep(taps, [cfg, cfg.but(name="h1", horizon_minutes=60, run_direct=False)])
    rows = summary.collect()
    assert [r["config_name"] for r in rows] == ["h1", "h3"]
    result = results["h3"]
    best = result.summary.first()
    assert rows[1]["best_model"] == best["model"] and rows[1]["best_mae"] == pytest.approx(best["mae"])
    assert {*station.EXPERTS, *station.BLENDS} == set(result.models)
    assert result.delta_ci.filter(F.col("baseline") != result.best_base).count() == 0
    assert result.blend_deltas.count() == len(station.BLENDS)
    assert result.profile.count() == 4
    assert result.candidates.filter("chosen").count() == cfg.top_k
    paths = station.save_station(result, str(tmp_path))
    assert "residual_linear_coef" in paths and "summary_table" in paths


def test_map_and_bucket_jobs(spark, files, tmp_path):
    cfg = NetworkConfig(bucket_minutes=60, horizon_minutes=180)
    reference = read_plain_places(spark, str(files / "REF_1.csv"))
    wide = reference.withColumns({c: F.lit(None).cast("string") for c in ("CODE", "NAME", "ST_NAME_SHORT")})
    wide = wide.withColumn("LN_NAME_SHORT", F.col("LN_NAME")).withColumn("IS_TEST", F.lit(0))
    paths = maps.save_labelled_maps(wide, "L9", str(tmp_path / "labelled"))
    mapped = maps.read_map(spark, paths["line_places"])
    assert {r["PLACE_ID"] for r in mapped.collect()} == {1, 3, 5}
    taps = read_events_csv(spark, str(files / "taps.csv"))
    maps.save_bucket_table(taps, mapped, cfg, str(tmp_path / "buckets"))
    buckets = read_buckets(spark, str(tmp_path / "buckets"))
    assert buckets.agg(F.sum("count")).first()[0] == taps.filter("PLACE_ID in (1, 3, 5)").count()
    assert "station_label" in buckets.columns
    scope = maps.save_network_maps(read_places(spark, str(files / "REF_1.csv")), cfg, str(tmp_path / "scope"))
    assert maps.read_map(spark, scope["network_places"]).count() == 6
    assert map_profile(maps.read_map(spark, scope["network_places"])).first()["lines"] == 2
