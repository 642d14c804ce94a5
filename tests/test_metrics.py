import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridertide.operators import bootstrap, metrics

MODELS = ["m1", "m2"]


def network_table(seed=0, n=90):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"station_key": rng.choice(list("abcde"), n), "y_true": rng.poisson(4, n).astype(float)})
    df["hl_actual"] = (df["y_true"] > 5).astype(int)
    means = {"a": 3.0, "b": 0.0, "c": 4.5, "d": np.nan, "e": 2.0}
    df["station_train_mean_target"] = df["station_key"].map(means)
    df.loc[df.station_key == "e", "hl_actual"] = 0
    df["m1"], df["m2"] = rng.poisson(4, n) * 1.0, df["y_true"] + rng.normal(0, 1, n)
    df["step"] = np.arange(n)
    return df


def spark_table(spark, df):
    return spark.createDataFrame([tuple(None if pd.isna(x) else x for x in r) for r in df.itertuples(index=False)],
        "station_key string, y_true double, hl_actual int, station_train_mean_target double, m1 double, m2 double, step int")


def plain(df, model, gamma):
    y, p = df["y_true"].to_numpy(), df[model].to_numpy()
    ae = np.abs(y - p)
    mean = df["station_train_mean_target"].replace(0, np.nan).fillna(y.mean()).to_numpy()
    w = (np.maximum(y, 0) / np.maximum(mean, 1e-9)) ** gamma
    high = df["hl_actual"].to_numpy() == 1
    out = [ae.mean(), np.sqrt((ae**2).mean()), ae.sum() / np.abs(y).sum() if np.abs(y).sum() else np.nan, (ae * w).mean()]
    if high.any():
        return out + [ae[high].mean(), np.maximum(y - p, 0)[high].mean(), (p < y)[high].mean()]
    return out + [np.nan] * 3


@pytest.mark.parametrize("gamma", [1.0, 0.7])
def test_micro_and_macro(spark, gamma):
    df = network_table()
    table = spark_table(spark, df)
    micro = metrics.micro_metrics(table, MODELS, gamma).toPandas().set_index("model")
    macro = metrics.macro_metrics(table, MODELS, gamma).toPandas().set_index("model")
    for m in MODELS:
        np.testing.assert_allclose(micro.loc[m, list(metrics.NETWORK_METRICS)].astype(float), plain(df, m, gamma))
        parts = np.array([plain(g, m, gamma) for _, g in df.groupby("station_key")])
        np.testing.assert_allclose(macro.loc[m, list(metrics.NETWORK_METRICS)].astype(float), np.nanmean(parts, axis=0))


def test_undefined_metrics_are_null(spark):
    df = network_table().assign(y_true=0.0, hl_actual=0)
    row = metrics.micro_metrics(spark_table(spark, df), ["m1"]).first()
    assert row["wmape"] is None and row["hl_mae"] is None and row["mae"] is not None
    assert metrics.series_metrics(spark_table(spark, df), ["m1"]).first()["wmape"] is None


def test_series_metrics(spark):
    df = network_table(1)
    got = metrics.series_metrics(spark_table(spark, df), MODELS).toPandas().set_index("model")
    y = df["y_true"]
    ae = (y - df["m2"]).abs()
    expected = [ae.mean(), np.sqrt((ae**2).mean()), ae.sum() / y.sum(), (ae * y / y.mean()).mean()]
    np.testing.assert_allclose(got.loc["m2", list(metrics.STATION_METRICS)].astype(float), expected)


def test_orders_and_picks(spark):
    table = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None), ("d", 0.5)], "model string, mae double")
    assert [r["model"] for r in metrics.leaderboard(table, "mae").collect()] == ["d", "a", "b", "c"]
    assert metrics.best_model(table, "mae") == "d" and metrics.top_models(table, "mae", 2) == ["d", "a"]
    terms = spark.createDataFrame([("x", -3.0), ("y", 2.0), ("z", 0.1)], "feature string, coef double")
    assert [r[0] for r in metrics.top_terms(terms, "coef", 2).collect()] == ["x", "y"]
    assert [r[0] for r in metrics.top_terms(terms, "coef", 2, by_size=False).collect()] == ["y", "z"]


def reps_of(df):
    return {tuple(r)[:-1]: r["value"] for r in df.collect()}


def test_station_replicates_match_resampled_rows(spark):
    df = network_table(2)
    table = spark_table(spark, df)
    times = bootstrap.station_draws(table, 6, 11).toPandas()
    assert (times.groupby("rep")["times"].sum() == 5).all()
    got = reps_of(bootstrap.station_replicates(table, MODELS, 6, 11, 0.7).select("rep", "mode", "model", "metric", "value"))
    for rep, part in times.groupby("rep"):
        rows = pd.concat([df[df.station_key == k] for k, n in zip(part.station_key, part.times) for _ in range(n)])
        for m in MODELS:
            micro = plain(rows, m, 0.7)
            macro = np.nanmean([plain(g, m, 0.7) for _, g in rows.groupby("station_key")], axis=0)
            for i, name in enumerate(metrics.NETWORK_METRICS):
                assert got[rep, "micro", m, name] == pytest.approx(micro[i])
                assert got[rep, "macro", m, name] == pytest.approx(macro[i])


def test_replicates_do_not_depend_on_partitions(spark):
    table = spark_table(spark, network_table(3))
    ends = []
    for n in (1, 13):
        reps = bootstrap.station_replicates(table.repartition(n), MODELS, 20, 5)
        points = bootstrap.station_estimates(table.repartition(n), MODELS)
        rows = bootstrap.delta_intervals(reps, points, ["m1"]).collect()
        ends.append({(r["mode"], r["metric"]): (round(r["ci_low"], 9), round(r["ci_high"], 9)) for r in rows})
    assert ends[0] == ends[1] and len(ends[0]) == 14


def test_block_replicates_match_resampled_rows(spark):
    df = network_table(4, n=23)
    table = spark_table(spark, df)
    got = reps_of(bootstrap.block_replicates(table, MODELS, "step", 5, 4, 9).select("rep", "model", "metric", "value"))
    n_blocks, size = 6, 23
    blocks = spark.range(5).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"))
    starts = blocks.select("rep", "b", bootstrap.draw(F.col("rep"), F.col("b"), 9, F.lit(size - 4 + 1)).alias("s")).toPandas()
    for rep, part in starts.groupby("rep"):
        index = np.concatenate([np.arange(s, s + 4) for s in part.sort_values("b").s])[:size]
        rows = df.iloc[index]
        ae = (rows["y_true"] - rows["m1"]).abs()
        assert got[rep, "m1", "mae"] == pytest.approx(ae.mean())
        assert got[rep, "m1", "wmape"] == pytest.approx(ae.sum() / rows["y_true"].sum())
        assert got[rep, "m1", "lw_mae"] == pytest.approx((ae * rows["y_true"] / rows["y_true"].mean()).mean())
    with pytest.raises(ValueError):
        bootstrap.block_replicates(table.filter("step < 0"), MODELS, "step", 5, 4, 9)


def test_deltas_are_significant_when_clear(spark):
    df = network_table(6)
    df["m1"] = df["y_true"] + 10
    table = spark_table(spark, df)
    reps = bootstrap.station_replicates(table, MODELS, 50, 1)
    rows = bootstrap.delta_intervals(reps, bootstrap.station_estimates(table, MODELS), ["m1"]).collect()
    mae = [r for r in rows if r["metric"] == "mae" and r["mode"] == "micro"][0]
    assert mae["significant_95"] and mae["delta_estimate"] > 0 and mae["model"] == "m2"
