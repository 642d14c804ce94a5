import numpy as np
import pytest
from pyspark.sql import functions as F

from ridertide.operators import ranking


def test_range_codes_equal_window_codes(spark):
    keys = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("k"))
    ordered = sorted(r["k"] for r in keys.collect())
    got = {r["k"]: r["code"] for r in ranking.range_codes(keys, "k", "code").collect()}
    assert got == {k: i for i, k in enumerate(ordered)}


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_codes_with_missing_values(spark, partitions):
    rows = [("b", "y"), ("a", "x"), ("c", None), ("d", "y"), (None, "x"), ("e", None)]
    df = spark.createDataFrame(rows, "k string, g string").repartition(partitions)
    got = {tuple(r) for r in ranking.add_codes(df, {"k": "ck", "g": "cg"}).select("k", "ck", "cg").collect()}
    assert got == {("a", 0, 0), ("b", 1, 1), ("c", 2, 2), ("d", 3, 1), ("e", 4, 2), (None, 5, 0)}
    codes = {tuple(r) for r in ranking.dense_codes(df, "g", "code").collect()}
    assert codes == {("x", 0), ("y", 1)}


@pytest.mark.parametrize("last", [ranking.LAST_VALUES, 3])
@pytest.mark.parametrize("kind", ["heavy", "ties", "few", "one", "signed"])
def test_exact_quantiles(spark, kind, last, monkeypatch):
    monkeypatch.setattr(ranking, "LAST_VALUES", last)
    rng = np.random.default_rng(4)
    values = {
        "heavy": np.concatenate([rng.normal(0, 1, 4_000), rng.normal(0, 1e6, 30)]),
        "ties": np.repeat([0.0, 0.0, 1.0, 5.0], 1_000),
        "few": rng.normal(0, 1, 37),
        "one": np.array([4.0]),
        "signed": np.round(rng.normal(0, 3, 3_000)),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(7)
    probs = [0.0, 0.05, 0.5, 0.8, 0.95, 1.0]
    got = ranking.exact_quantiles(df, "v", probs)
    np.testing.assert_allclose(got, np.quantile(values, probs), rtol=1e-12, atol=1e-12)


def test_passes_do_not_depend_on_the_number_of_probabilities(spark, monkeypatch):
    monkeypatch.setattr(ranking, "LAST_VALUES", 40)
    df = spark.range(30_000).select((F.xxhash64("id") / 2**40).alias("v"))
    values = np.array([r["v"] for r in df.collect()])
    jobs = []
    real = ranking.described
    monkeypatch.setattr(ranking, "described", lambda grouped: jobs.append(1) or real(grouped))
    taken = []
    for probs in ([0.5], [i / 20 for i in range(21)]):
        jobs.clear()
        np.testing.assert_allclose(ranking.exact_quantiles(df, "v", probs), np.quantile(values, probs), rtol=1e-12)
        taken.append(len(jobs))
    assert taken[1] <= taken[0] + 1 <= 4


def test_codes_of_columns_of_several_types(spark):
    rows = [(3, "b", 0.5), (1, None, 2.0), (None, "a", 0.5), (10, "b", None), (1, "a", -1.0)]
    df = spark.createDataFrame(rows, "k long, g string, x double").repartition(3)
    got = {tuple(r) for r in ranking.add_codes(df, {"k": "ck", "g": "cg", "x": "cx"}).select("k", "g", "x", "ck", "cg", "cx").collect()}
    order = [sorted({r[i] for r in rows}, key=lambda v: (v is None, v if v is not None else 0)) for i in (0, 2)]
    names = ["a", "b", None]
    assert got == {(*r, order[0].index(r[0]), names.index(r[1]), order[1].index(r[2])) for r in rows}


def test_quantiles_of_nothing(spark):
    assert ranking.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]
