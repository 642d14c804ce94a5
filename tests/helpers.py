"""Small series and plain pandas versions of the window features."""

import datetime as dt

import numpy as np
import pandas as pd

EPOCH = dt.datetime(1970, 1, 1)


def step(text: str, minutes: int) -> int:
    return int((dt.datetime.fromisoformat(text) - EPOCH).total_seconds() // (60 * minutes))


def counts_frame(spark, series: dict[str, tuple[int, list[float]]]):
    """Counts from (first step, dense values) per station; zeros become gaps, as in real bucket tables."""
    rows = [
        (key, first + i, float(v)) for key, (first, values) in series.items() for i, v in enumerate(values) if v > 0
    ]
    return spark.createDataFrame(rows, "station_key string, step bigint, count double")


def three_stations(seed: int = 5) -> dict[str, tuple[int, list[float]]]:
    """30, 7 and 25 buckets of 4 hours each; first and last bucket of each are non-zero."""
    rng = np.random.default_rng(seed)
    base = step("2024-01-01T03:00:00", 240)
    out = {}
    for key, offset, n in (("a", 0, 30), ("b", 3, 7), ("c", 11, 25)):
        values = rng.integers(0, 5, n).astype(float)
        values[0], values[-1] = 1.0, 2.0
        out[key] = (base + offset, list(values))
    return out


def pandas_features(first: int, values: list[float], lags, rolls, stds, horizon: int, day: int) -> pd.DataFrame:
    s = pd.Series(values)
    out = pd.DataFrame({"step": first + np.arange(len(values)), "count": s})
    out["target_h"] = pd.concat([s.shift(-k) for k in range(1, horizon + 1)], axis=1).sum(axis=1, min_count=horizon)
    out["target_daylag"] = out["target_h"].shift(day)
    for n in lags:
        out[f"lag_{n}"] = s.shift(n)
    for n in rolls:
        out[f"roll_sum_{n}"] = s.shift(1).rolling(n).sum()
        out[f"roll_mean_{n}"] = s.shift(1).rolling(n).mean()
    for n in stds:
        out[f"roll_std_{n}"] = s.shift(1).rolling(n).std()
    return out


def records(df, columns=None):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def same(actual: pd.DataFrame, expected: pd.DataFrame, keys: list[str]):
    columns = list(expected.columns)
    a = actual[columns].sort_values(keys).reset_index(drop=True)
    b = expected.sort_values(keys).reset_index(drop=True)
    for frame in (a, b):
        for c in columns:
            if c not in keys:
                frame[c] = frame[c].astype(float)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-9)
