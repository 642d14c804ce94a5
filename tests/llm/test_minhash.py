import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ridertide.llm import minhash
from ridertide.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def classes(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, t or "", shingles(t)) for i, t in rows]
    for k, (i, t, s) in enumerate(sets):
        for j, u, r in sets[:k]:
            if t == u or (s and r and len(s & r) >= 0.8 * len(s | r)):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i, _ in rows}


LEAST = -(2**63)


def classes_of_rows(rows):
    """The smallest doc_id of each row's class, rows being documents of their own."""
    found = classes(list(enumerate(t for _, t in rows)))
    ids = [LEAST if d is None else d for d, _ in rows]
    smallest = {}
    for i, c in found.items():
        smallest[c] = min(smallest.get(c, ids[i]), ids[i])
    return sorted((ids[i], smallest[c]) for i, c in found.items())


def got_classes(df):
    least = lambda x: LEAST if x is None else x
    return sorted((least(r["doc_id"]), least(r["class_id"])) for r in minhash.near_duplicates(df).collect())


def test_same_as_brute_force(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got_classes(odd) == classes_of_rows(rows)


def edited(text, word):
    parts = text.split()
    parts[len(parts) // 2] = word
    return " ".join(parts)


def shared_ids():
    rng = random.Random(3)
    a, b, o = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(90)) for k in "abo")
    return [(1, a), (2, b), (3, edited(a, "x")), (4, edited(b, "y")), (2, edited(a, "z")), (7, o), (None, b), (None, b), (2, o)]


def test_rows_that_share_a_doc_id(spark):
    rows = shared_ids()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got_classes(df) == classes_of_rows(rows)
    five = spark.createDataFrame(rows[:5], "doc_id long, text string")
    assert got_classes(five) == [(1, 1), (2, 1), (2, 2), (3, 1), (4, 2)]


def test_one_row_of_each_class_is_left(spark):
    rows = shared_ids()
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, other int").repartition(3)
    kept = minhash.without_near_duplicates(df)
    assert kept.columns == ["doc_id", "text", "other"]
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([rows[0], rows[6], rows[8]], key=str)


def test_many_copies_of_a_text(spark):
    rows = [(i, "one text that is there a great many times indeed") for i in range(400)] + [(1000 + i, f"number {i} alone " * 6) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got_classes(df) == classes_of_rows(rows)
    assert minhash.without_near_duplicates(df).count() == 31


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_large_groups(spark, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(120):  # edits of one text, some further apart than the threshold
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    chain = list(base[:100])
    for i in range(120, 140):  # each near the one before only
        chain = chain[4:] + [f"y{rng.randrange(10**6)}" for _ in range(4)]
        rows.append((i, " ".join(chain)))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def repeated(rng, n, part, times, changed=0):
    """Two texts of n words: the second without `changed` of them, and with a part repeated."""
    base = [f"w{rng.randrange(10**9)}" for _ in range(n)]
    other = base[: n - changed] + [f"x{rng.randrange(10**9)}" for _ in range(changed)]
    return " ".join(base), " ".join(other + other[:part] * times)


def test_pairs_that_repeat_unequally(spark):
    rng = random.Random(8)
    rows = []
    for part, times, changed in [(150, 30, 0), (30, 50, 0), (150, 5, 25), (30, 300, 0)] * 15:
        for text in repeated(rng, 300, part, times, changed):
            rows.append((len(rows), text))
    want = classes(rows)
    assert len(set(want.values())) == len(rows) / 2
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_bands_of_sets_and_of_weights():
    texts = ["a b c d e f g", "a b c d e f g " * 2, "", None, "k l m n o " + "p q r s t u " * 9]
    hashed, times, each = minhash.shingles(pa.array(texts))
    keys, counts = minhash.band_keys(hashed, times, each, 40, 6)
    assert counts[0] == 40 and counts[2] == counts[3] == 0 and 40 < counts[4] <= 80
    ends = np.cumsum(counts)
    for n, end in zip(counts, ends, strict=True):
        assert len(set(keys[end - n : end].tolist())) == n
    weighted = minhash.bands_of(minhash.signatures(hashed, 1 + np.log(times), each, 240), 6)
    assert set(weighted[4].tolist()) <= set(keys[ends[3] : ends[4]].tolist())


def test_registers_estimate_the_probability_jaccard_similarity():
    rng = np.random.default_rng(3)
    common, only_a, only_b = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (60, 20, 30))
    a, b = np.concatenate([common, only_a]), np.concatenate([common, only_b])
    wa, wb = rng.uniform(1, 3, len(a)), rng.uniform(1, 3, len(b))
    signature = minhash.signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([len(a), len(b)]), 4000)
    x = np.concatenate([wa / wa.sum(), np.zeros(30)])
    y = np.concatenate([wb[:60] / wb.sum(), np.zeros(20), wb[60:] / wb.sum()])
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(60))
    assert abs((signature[0] == signature[1]).mean() - exact) < 0.03


def test_signatures_do_not_depend_on_the_batch():
    texts = ["a b c d e f g", "", None, "x", "a b c d e f g"]
    whole = minhash.signatures(*[v if k != 1 else 1 + np.log(v) for k, v in enumerate(minhash.shingles(pa.array(texts)))], 24)
    for i, t in enumerate(texts):
        one = minhash.signatures(*[v if k != 1 else 1 + np.log(v) for k, v in enumerate(minhash.shingles(pa.array([t], pa.string())))], 24)
        assert (whole[i] == one[0]).all()


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(200, k) for k in range(201, 260)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["class_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_empty(empty):
    assert minhash.near_duplicates(empty).count() == 0
