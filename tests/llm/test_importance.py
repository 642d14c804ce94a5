import re

import numpy as np
import pyarrow as pa
import pytest

from ridertide.llm import importance
from ridertide.llm.arrays import mixed


def test_ratio_is_that_of_the_counts(spark):
    rows = [("good text here", True), ("good good words", True), ("bad text ## ##", False), (None, False)]
    got = importance.fit(spark.createDataFrame(rows, "text string, is_target boolean"), buckets=256)
    raw, target = np.ones(256), np.ones(256)
    for text, chosen in rows:
        word, _, pair, _ = importance.grams(pa.array([text], pa.string()), 256)
        for g in [*word, *pair]:
            raw[g] += 1
            target[g] += chosen
    assert np.allclose(got, np.log(target / target.sum()) - np.log(raw / raw.sum()))


@pytest.mark.parametrize("last_rows", [20_000, 50])
def test_kth_largest(spark, monkeypatch, last_rows):
    monkeypatch.setattr(importance, "LAST_ROWS", last_rows)
    keys = np.round(np.random.default_rng(2).normal(size=3000), 2)  # with ties
    scores = spark.createDataFrame([(float(k),) for k in keys], "key double").cache()
    for k in (1, 2, 1500, 2999, 3000):
        assert importance.kth_largest(scores, k) == np.sort(keys)[-k]


def test_kth_largest_of_ties(spark, monkeypatch):
    monkeypatch.setattr(importance, "LAST_ROWS", 10)
    scores = spark.createDataFrame([(v,) for v in [1.0] * 60 + [2.0] * 30 + [5.0]], "key double").cache()
    assert [importance.kth_largest(scores, k) for k in (1, 2, 31, 32, 91)] == [5.0, 2.0, 2.0, 1.0, 1.0]


def test_odd_rows(odd, labels, empty):
    rows = importance.resampled(odd, labels, share=0.5).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    wordless = [r for r in rows if not (texts[r["doc_id"]] or "").split()]
    assert wordless and all(r["log_weight"] is None and r["key"] is None and not r["kept"] for r in wordless)
    kept = sorted((r["key"] for r in rows if r["kept"]), reverse=True)
    every = sorted((r["key"] for r in rows if r["key"] is not None), reverse=True)
    assert kept == every[: len(kept)] and len(kept) >= round(len(every) / 2)
    assert importance.resampled(empty, labels).count() == 0
    assert all(r["kept"] == (r["key"] is not None) for r in importance.resampled(odd, labels.limit(0)).collect())


def brute(rows, labelled, share, buckets, seed=17):
    """The whole query with dictionaries: counts of words and pairs, sums of log ratios, Gumbel keys, the k largest."""

    def parts(text):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", words)
        return [(w,) for w in words] + list(zip(words, words[1:], strict=False))

    def bucket(gram):
        word, _, pair, _ = importance.grams(pa.array([" ".join(gram)]), buckets)
        return int(word[0] if len(gram) == 1 else pair[0])

    where = {g: bucket(g) for _, t in rows for g in set(parts(t))}
    raw, target = np.ones(buckets), np.ones(buckets)
    good = {d for d, quality, toxic in labelled if quality == 1 and not toxic and d is not None}
    for doc, text in rows:
        for g in parts(text):
            raw[where[g]] += 1
            target[where[g]] += doc in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    keys = []
    for doc, text in rows:
        number = np.array([-(2**63) if doc is None else doc]).astype(np.uint64)
        uniform = ((mixed(mixed(number + np.uint64(seed))) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
        keys.append(sum(ratio[where[g]] for g in parts(text)) - np.log(-np.log(uniform[0])) if parts(text) else None)
    known = sorted((k for k in keys if k is not None), reverse=True)
    least = known[round(len(known) * share) - 1]
    return [(doc, None if k is None else round(float(k), 6), k is not None and bool(k >= least - 1e-12)) for (doc, _), k in zip(rows, keys, strict=True)]


def test_query_against_brute_force(spark, odd, labels):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if len(r["text"] or "") < 5000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = importance.resampled(docs, labels, share=0.4, buckets=512).collect()
    got = [(r["doc_id"], None if r["key"] is None else round(r["key"], 6), r["kept"]) for r in got]
    want = brute(rows, [tuple(r) for r in labels.collect()], 0.4, 512)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_target_like_text_is_drawn(spark):
    rows = [(i, ("fine plain words about the sea " if i % 2 else "## $$ buy %% now && ") * 5) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    out = importance.resampled(docs, labels).collect()
    assert {r["doc_id"] % 2 for r in out if r["kept"]} == {1} and sum(r["kept"] for r in out) == 40


def test_noise_draws_in_proportion(spark):
    """With two weights, Gumbel keys prefer the heavier as often as its share says."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS text")
    ratio = np.zeros(256)
    ratio[importance.grams(pa.array(["a"]), 256)[0][0]] = np.log(3.0)
    rows = {r["doc_id"]: r["key"] for r in importance.weighted(docs, ratio, seed=1).collect()}
    wins = np.mean([rows[i] > rows[i + 1] for i in range(0, 4000, 2)])
    assert abs(wins - 0.75) < 0.03
