import numpy as np
import pytest
from pyspark.sql import functions as F

from ridertide.llm import mixing


def projected(tokens, posterior, weights, steps=5000):
    """Plain projected gradient, small steps, as a reference for the objective."""
    r = np.ones(len(tokens))
    total = tokens.sum()
    for _ in range(steps):
        gap = (tokens[:, None] * posterior * r[:, None]).sum(0) / total - weights
        r = np.maximum(0, r - 0.5 * posterior @ gap)
    return r


@pytest.mark.parametrize("weights", [(0.5, 0.3, 0.2), (0.9, 0.1, 0.0), (0.05, 0.05, 0.9)])
def test_rates_meet_the_targets(spark, weights):
    rng = np.random.default_rng(6)
    tokens, posterior = rng.integers(1, 200, 300), rng.dirichlet([0.4, 0.3, 0.2], 300)
    rows = [(int(t), p.tolist()) for t, p in zip(tokens, posterior, strict=True)]
    known = spark.createDataFrame(rows, "tokens long, posterior array<double>").cache()
    weights = np.array(weights)
    rate = mixing.rate_of(F.col("posterior"), mixing.fit_rates(known, weights, pull=1e-5))
    got = known.select("tokens", "posterior", rate.alias("rate")).toPandas()
    assert (got.rate >= 0).all()
    p = np.array(got.posterior.tolist())
    reached = (got.tokens.to_numpy()[:, None] * p * got.rate.to_numpy()[:, None]).sum(0) / tokens.sum()
    r = projected(tokens, posterior, weights)
    best = (tokens[:, None] * posterior * r[:, None]).sum(0) / tokens.sum()
    assert np.abs(reached - weights).max() < np.abs(best - weights).max() + 1e-3


def test_rates_are_the_least_of_the_objective(spark):
    """No other non-negative rates do better, by plain projected gradient on a rate for each document."""
    rng = np.random.default_rng(7)
    tokens, posterior = rng.integers(1, 200, 120).astype(float), rng.dirichlet([0.8, 0.5, 0.3], 120)
    known = spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(tokens, posterior, strict=True)], "tokens long, posterior array<double>").cache()
    weights, pull = np.array([0.9, 0.07, 0.03]), 0.05
    got = known.select("tokens", "posterior", mixing.rate_of(F.col("posterior"), mixing.fit_rates(known, weights, pull)).alias("rate")).toPandas()

    def loss(r, p, t):
        gap = (t[:, None] * p * r[:, None]).sum(0) / t.sum() - weights
        return (gap**2).sum() + pull * (t * (r - 1) ** 2).sum() / t.sum()

    r = np.ones(120)
    for _ in range(20_000):
        gap = (tokens[:, None] * posterior * r[:, None]).sum(0) / tokens.sum() - weights
        r = np.maximum(0, r - 0.5 * (posterior @ gap + pull * (r - 1)))
    mine = loss(got.rate.to_numpy(), np.array(got.posterior.tolist()), got.tokens.to_numpy().astype(float))
    assert mine <= loss(r, posterior, tokens) + 1e-6


def test_posteriors_match_the_formula(spark, odd, labels):
    domains = ["good", "poor"]
    model = mixing.fit(odd.select("doc_id", "text"), labels, domains, buckets=64)
    assert (model.odds[0] == 0).all() and model.slope.shape == (1, 1)
    rows = mixing.posteriors(odd.select("doc_id", "text"), model, domains)
    rows = rows.withColumn("buckets", mixing.buckets_of(F.coalesce("text", F.lit("")), 64)).collect()
    for r in rows:
        buckets = np.array(r["buckets"], int) - 1
        logs = np.r_[0, model.slope @ model.odds[1:, buckets].sum(1) + model.shift]
        want = np.exp(logs - logs.max())
        assert np.allclose(r["posterior"], want / want.sum(), atol=1e-4)
        assert r["tokens"] == len((r["text"] or "").replace("\x00", "x").split(None)) or r["text"] is None or "\x00" in r["text"] or not r["text"].isascii()


def test_odd_rows(spark, odd, labels, empty):
    rows = mixing.mixed(odd, labels).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
        assert abs(r["p_good"] + r["p_poor"] - 1) < 1e-9
    plain = mixing.mixed(odd, labels.limit(0)).collect()
    assert {(r["rate"], r["copies"]) for r in plain} == {(1.0, 1)}
    assert mixing.mixed(empty, labels).count() == 0


def test_copies_have_the_right_mean(spark, odd):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'a b c' AS text")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mixed(docs, labels, {"good": 0.8, "poor": 0.2}).agg(F.avg("rate"), F.avg("copies")).first()
    assert abs(out[0] - out[1]) < 0.03


def test_toxic_text_is_a_domain_of_its_own(spark):
    kinds = {"good": "fine words of sense", "poor": "junk junk spam", "toxic": "vile insult fine words"}
    docs = spark.createDataFrame([(i, " ".join([kinds[list(kinds)[i % 3]]] * 9)) for i in range(300)], "doc_id long, text string")
    # Toxic documents have good quality, or none, as well as poor.
    rows = [(i, *[(1, 0), (0, 0), ([1, None, 0][i // 3 % 3], 1)][i % 3]) for i in range(90)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = mixing.mixed(docs, labels).collect()
    rate = [sum(r["rate"] for r in got if r["doc_id"] % 3 == k) / 100 for k in range(3)]
    assert rate[0] > 1 and rate[2] < 0.2
    for r in got:
        assert abs(r["p_good"] + r["p_poor"] - 1) < 1e-9
        assert (r["p_toxic"] > 0.5) == (r["doc_id"] % 3 == 2)


def test_calibration_is_the_likeliest(spark):
    """Known slopes and shifts are found again; with tokens as weights, expected shares are those of the labels."""
    rng = np.random.default_rng(4)
    scores = rng.normal(size=(6000, 2)) * 2
    true, at = np.array([[1.5, 0.0], [-0.3, 0.4]]), np.array([-1.0, -2.0])

    def shares(slope, shift):
        z = np.c_[np.zeros(len(scores)), scores @ slope.T + shift]
        return np.exp(z) / np.exp(z).sum(1, keepdims=True)

    domain = (rng.random(6000)[:, None] > shares(true, at).cumsum(1)).sum(1)
    tokens = rng.integers(1, 50, 6000).astype(float)
    slope, shift = mixing.calibrated(scores, domain, tokens, np.array([0.0, 0.0]))
    assert np.allclose(slope, true, atol=0.2) and np.allclose(shift, at, atol=0.2)
    p = shares(slope, shift)
    for k in (1, 2):
        assert abs((tokens * p[:, k]).sum() - tokens[domain == k].sum()) < 1e-2 * tokens.sum()
    # Scores that tell nothing get a slope near 0, and rows of one domain don't send the fit off.
    slope, _ = mixing.calibrated(rng.normal(size=(500, 2)), rng.integers(0, 3, 500), np.ones(500), np.zeros(2))
    assert np.abs(slope).max() < 0.4
    slope, shift = mixing.calibrated(scores[:30], np.zeros(30, int), np.ones(30), np.zeros(2))
    assert np.isfinite(slope).all() and (shift < 0).all()


def test_buckets_that_tell_nothing_count_nothing():
    having = np.array([[50.0, 40, 3], [48, 2, 3], [50, 41, 30]])
    odds = mixing.log_odds(having, np.array([100.0, 100, 100]))
    assert (odds[:, 0] == 0).all() and odds[1, 1] < -1 and odds[2, 2] > 1


@pytest.mark.parametrize("count", [300, 1500])
def test_labelled_shares_move_to_the_targets(spark, count):
    """Domains whose words overlap, few labels: toxic and poor tokens come nearer to their targets, by the labels."""
    rng = np.random.default_rng(count)
    common = [f"c{i}" for i in range(150)]
    own = {0: [f"g{i}" for i in range(60)], 1: [f"p{i}" for i in range(60)], 2: [f"t{i}" for i in range(60)]}
    rows, labels = [], []
    for i in range(count):
        kind = int(rng.choice(3, p=[0.6, 0.25, 0.15]))
        size = int(rng.integers(5, 120))
        text = [str(rng.choice(own[kind] if rng.random() < 0.12 else common)) for _ in range(size)]
        rows.append((i, " ".join(text), kind, size))
        labels.append((i, int(kind == 0), int(kind == 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int, size int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rate = {r["doc_id"]: r["rate"] for r in mixing.mixed(docs, known).collect()}
    targets = list(mixing.TARGETS.values())
    total, mixed_ = sum(r[3] for r in rows), sum(r[3] * rate[r[0]] for r in rows)
    for kind in (1, 2):
        before = sum(r[3] for r in rows if r[2] == kind) / total
        after = sum(r[3] * rate[r[0]] for r in rows if r[2] == kind) / mixed_
        assert abs(after - targets[kind]) < abs(before - targets[kind])


def test_copies_in_place(spark, odd, labels):
    """Rows have the copies of `mixed`, each by its own text, and keep their columns."""
    out = mixing.with_copies(odd, labels, "times")
    assert out.columns == [*odd.columns, "times"]
    got = sorted(str((r["doc_id"], r["times"])) for r in out.collect())
    assert got == sorted(str((r["doc_id"], r["copies"])) for r in mixing.mixed(odd, labels).collect())
