import math

import numpy as np
import pyarrow as pa
import pytest

from ridertide.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string, deviation string, n int"


def random_rows(count: int, k: int, seed: int = 3) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(k, k)) * np.linspace(1, 0.1, k)
    return (rng.normal(size=(count, k)) @ mix + 3).astype(np.float32).tolist()


def brute(vectors: list[list[float]]):
    """n, sums, covariance of the distinct whole vectors, in plain Python whole numbers where they are exact."""
    x = sorted({tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors})
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = np.array([[a - s / n for a, s in zip(v, sums, strict=True)] for v in x])
    return n, sums, d.T @ d / n


@pytest.mark.parametrize("shape", [(6, 6), (9, 4), (40, 40)])
def test_factor_and_rotations(shape):
    rng = np.random.default_rng(1)
    a = rng.normal(size=shape)
    v = a @ a.T
    factor = whitening.pivoted_cholesky(v)
    assert factor.shape[1] == min(shape) and np.allclose(factor @ factor.T, v)
    values, vectors = whitening.jacobi(factor)
    want = np.linalg.eigvalsh(v)[::-1][: min(shape)]
    assert np.allclose(values, want, rtol=1e-10)
    assert np.allclose(vectors.T @ vectors, np.eye(min(shape)), atol=1e-12)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-9 * values[0])


def test_no_rank():
    values, vectors = whitening.jacobi(whitening.pivoted_cholesky(np.zeros((5, 5))))
    assert len(values) == 0 and vectors.shape == (5, 0)


def test_query_against_brute_force(spark):
    vectors = random_rows(300, 20)
    vectors += [vectors[0]] * 150  # copies count once
    rows = [(i, v, "s", "t", 1) for i, v in enumerate(vectors)]
    out = whitening.components_of(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    n, sums, v = brute(vectors)
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(out) == 450 * 16 and {r["n"] for r in out} == {n}
    assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-10
    signs: dict[int, set] = {}
    for r in out:
        x = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vectors[r["vec_id"]]]
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        k = r["component"] - 1
        want = sum((a - s / n) * b for a, s, b in zip(x, sums, basis[:, k], strict=True)) / math.sqrt(values[k])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-8
        if abs(want) > 1e-3:
            signs.setdefault(k, set()).add(r["whitened"] * want > 0)
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, inf, 1.0], [1e30, 0.0, 0.0], [1.0, 2.0], [1.0] * 4]
    good = [[0.0, 1.0, 2.0], [0.0, 1.0, 2.0], [3.0, 1.0, 2.0], [0.5, -7.0, 2.0]]
    rows = [(i if i else None, v, "s", "t", 1) for i, v in enumerate(good + odd)]
    table, model = whitening.whitened(spark.createDataFrame([*rows, rows[1]], SCHEMA))
    assert table.columns == ["vec_id", "embedding", "n", "whitened", "deviation"]
    got = table.collect()
    assert sorted(r["vec_id"] or 0 for r in got) == [0, 1, 1, 2, 3]
    assert model.n == 3 and all(len(r["whitened"]) == 2 for r in got)  # three points span a plane
    assert model.identity_error < 1e-9


def test_equal_vectors_and_empty_tables(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], "s", "t", 1) for i in range(5)], SCHEMA)
    table, model = whitening.whitened(same)
    assert {(tuple(r["whitened"]), r["deviation"]) for r in table.collect()} == {((), 0)} and model.n == 1
    assert whitening.components_of(same).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.components_of(empty).count() == 0
    nulls = spark.createDataFrame([(1, None, "s", "t", 1), (2, [], "s", "t", 1)], SCHEMA)
    assert whitening.components_of(nulls).count() == 0


def test_large_deviations_are_exact_or_null():
    model = whitening.Whitening(10**6, [10**6 * 5 + 3, 7], np.empty(0), np.empty((2, 0)), 0.0)
    x = np.array([[5 + 10**6, 0], [5, 3]], np.int64)
    want = [(10**12 - 3) ** 2 + 49, 9 + (3 * 10**6 - 7) ** 2]
    assert whitening.deviations(x, model) == [w if w < 1 << 63 else None for w in want]


def test_entries_of_slices():
    lists = pa.array([[1.0], None, [2.0, None], [3.0, -0.01]], pa.list_(pa.float32())).slice(1)
    x, offsets, whole = whitening.entries(lists)
    assert offsets.tolist() == [0, 0, 2, 4] and whole.tolist() == [False, False, True]
    assert x[2:].tolist() == [1_000_192, 999_999]
