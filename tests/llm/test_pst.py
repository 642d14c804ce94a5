import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from ridertide.llm import pst

SCHEMA = "doc_id long, text string, score string, part int"


def split(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [""]


def brute(rows: list[tuple], threshold: float = 0.5) -> list[tuple]:
    """The tree with dictionaries: one distribution for each context of the texts to learn from."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    texts = [split(t) for _, t in rows]
    counts: Counter = Counter()
    after: dict[tuple, Counter] = defaultdict(Counter)
    for words, out in zip(texts, held, strict=True):
        if out:
            continue
        counts.update(words)
        path = [None, *words]
        for i in range(1, len(path)):
            after[path[i - 1],][path[i]] += 1
            if i > 1:
                after[path[i - 2], path[i - 1]][path[i]] += 1
    n, v = sum(counts.values()), len(counts)

    def root(w: str) -> float:
        return (counts[w] + 0.1) / (n + 0.1 * (v + 1))

    kept: dict[tuple, bool] = {}

    def given(context: tuple, w: str) -> float:
        """By the longest retained suffix of the context."""
        return smooth(context, w) if context and retained(context) else given(context[1:], w) if context else root(w)

    def smooth(context: tuple, w: str) -> float:
        seen = after[context]
        total = sum(seen.values())
        return max(seen[w] - pst.DISCOUNT, 0) / total + pst.DISCOUNT * len(seen) / total * given(context[1:], w)

    def retained(context: tuple) -> bool:
        if context not in after:
            return False
        if context not in kept:
            seen = after[context]
            total = sum(seen.values())
            apart, mass = 0.0, 0.0
            for w in seen:
                p = smooth(context, w)
                mass += p
                apart += p * math.log(p / given(context[1:], w))
            rest = pst.DISCOUNT * len(seen) / total
            kept[context] = total * (apart + (1 - mass) * math.log(rest)) >= threshold
        return kept[context]

    out = []
    for (doc, _), words, is_held in zip(rows, texts, held, strict=True):
        path = [None, *words]
        score = 0.0
        for i in range(1, len(path)):
            score += math.log10(given(tuple(path[max(0, i - 2) : i]), path[i]))
        base = sum(math.log10(root(w)) for w in words)
        out.append((doc, is_held, len(words), sum(counts[w] > 0 for w in words), n, base, score))
    return out


def compare(spark, rows: list[tuple], parts: int = 3, settings: pst.Settings | None = None) -> None:
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA).repartition(parts)
    order = lambda r: (r[0] is None, r[0] or 0, round(r[6], 6), round(r[5], 6))
    got = sorted((tuple(r) for r in pst.scored(df, settings=settings).collect()), key=order)
    want = sorted(brute(rows, settings.threshold if settings else 0.5), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9), (a, b)


def prose(seed: int, count: int) -> list[tuple]:
    rng = random.Random(seed)
    names = ["the", "The", "cat", "dog", "sat", "on", "É", "mat.", "ran", "日本", "a", "far", "x"]
    rows = [(i, " ".join(rng.choices(names, weights=range(13, 0, -1), k=rng.randint(0, 30))) + rng.choice(["", "\n", " z%d" % i])) for i in range(count)]
    return [*rows, (900, rows[3][1]), (901, rows[3][1]), (None, "the cat"), (None, None), (902, None), (903, ""), (900, "other text here")]


def test_scores_against_brute_force(spark):
    compare(spark, prose(1, 90))


def test_many_shards_blocks_and_waves(spark):
    compare(spark, prose(2, 60), 4, pst.Settings(shard_bytes=150, block_tokens=50, waves=3))


def test_hot_words_have_shards_of_their_own(spark):
    """Hot words are retained without test; with no threshold brute force retains all others too."""
    settings = pst.Settings(threshold=-1e9, shard_bytes=400, block_tokens=90, hot=30)
    compare(spark, prose(3, 70), 4, settings)


def test_hot_words_are_tested_as_contexts_like_others(spark):
    """Which words are hot is only a matter of layout: at each threshold the same contexts are kept."""
    for threshold in (0.5, 8.0, 20.0):
        compare(spark, prose(4, 70), 4, pst.Settings(threshold=threshold, shard_bytes=400, block_tokens=90, hot=30))


def test_odd_tables(spark):
    compare(spark, [(5, "only one text of no one"), (5, "only one text of no one")])
    assert pst.scored(spark.createDataFrame([], SCHEMA)).count() == 0
    none = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = pst.scored(spark.createDataFrame([(none, "a b", "s", 1)], SCHEMA)).collect()
    assert tuple(row) == (none, True, 3, 0, 0, 0.0, 0.0)
    compare(spark, [(1, "w " * 30_000), (2, "y" * 300_000), (3, "w w y"), (13, "w w w")])


def test_odd_rows_of_documents(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in pst.scored(odd).collect())
    assert got == sorted((str(r[0]), r[2], round(r[6], 6)) for r in brute(rows))


def test_distributions_sum_to_one():
    """A level's probabilities over all words add up to what its parents' do."""
    rng = np.random.default_rng(2)
    words_, contexts = 9, 5
    root = rng.random(words_)
    root /= root.sum()
    seen = rng.integers(0, [contexts, words_], (60, 2))
    every = np.array([(c, w) for c in range(contexts) for w in range(words_)])
    places = np.concatenate([seen, every])  # one more place of each pair that isn't learned from
    learn = np.concatenate([np.ones(60), np.zeros(len(every))])
    p, _ = pst.level(places[:, 0], places[:, 1], learn, root[places[:, 1]], words_, 0.5)
    assert np.allclose(p[60:].reshape(contexts, words_).sum(1), 1)


def test_packed_numbers():
    for kind in (np.uint8, np.uint32, np.uint64, np.float64):
        x = np.array([0, 1, 200, 7], kind)
        assert pst.unpacked(pst.packed(x), kind).tolist() == x.tolist()
        assert len(pst.unpacked(pst.packed(x[:0]), kind)) == 0


def test_held_out_texts_gain_from_contexts(spark):
    """Copies of passages are likelier under the tree than word by word."""
    rng = random.Random(5)
    passages = [" ".join(f"w{rng.randint(0, 200)}" for _ in range(40)) for _ in range(20)]
    rows = [(i, rng.choice(passages) + f" u{rng.randint(0, 50)} " + rng.choice(passages)) for i in range(200)]
    got = pst.scored(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert len(got) > 5 and all(r["score"] > r["base_score"] / 2 for r in got)


def test_tokens_of_texts():
    found, each = pst.tokens(pa.array(["A b\tB", None, "", "É é"]))
    assert each.tolist() == [4, 1, 1, 3]
    assert found[1] == found[2] and found[0] != found[1] and found[3] == found[4] == found[5] == pst.STOP
    assert found[6] != found[7]  # only A to Z is lowered


def test_questions_hold_no_earlier_block():
    """When the texts of the next block are asked for, nothing of the last one is held but what is sent."""

    class Rows:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    layout = pst.Layout(2, pst.Settings(block_tokens=20_000))
    held = []

    def batches():
        for i in range(3):
            held.append(tracemalloc.get_traced_memory()[0])
            texts = [" ".join(f"w{(i * j * k) % 50}" for k in range(500)) for j in range(60)]
            yield pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(60)), pa.array([True] * 60)], ["text", "key", "learn"])

    run = pst.questions(Rows(), layout, lambda b: pst.counted_words(b, layout))
    list(run(batches()))  # what is imported at the first use is no part of it
    tracemalloc.start()
    rows = [r.num_rows for r in run(batches())]
    tracemalloc.stop()
    assert rows == [2, 2, 2]
    assert held[-1] - held[-3] < 8 * 30_000  # less than one number for each token of a block


def test_a_block_is_counted_in_few_bytes_a_token():
    """Executors hold several such tasks: what a block takes at its peak beside its texts is bounded by token."""

    class Rows:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    layout = pst.Layout(5, pst.Settings(block_tokens=400_000))
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 9_000)}" for _ in range(999)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(20)), pa.array([True] * 20)], ["text", "key", "learn"])
    run = pst.questions(Rows(), layout, lambda b: pst.counted_words(b, layout))
    list(run(iter([batch])))
    tracemalloc.start()
    rows = [r.num_rows for r in run(iter([batch] * 20))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [5]
    assert peak < 80 * 400_000, peak / 400_000


def test_a_shard_holds_nothing_of_its_batches():
    """Places and answers of a shard come mixed in a stream; a batch is freed before the next but one is read."""
    big = b"x" * 1_000_000
    names = ["shard", "block", "keys", "word", "last", "before", "slot", "slots", "docs", "learn", "kind", "counts", "distinct"]
    lists = pa.list_(pa.binary())
    kinds = [pa.int32(), pa.int64(), pa.binary(), *[lists] * 4, pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
    place = [1, 7, big, [big], [big], [big], [big], b"s", [4, 5], b"l", None, None, None]
    answer = [1, None, b"k", *[None] * 7, 0, b"c", 4]
    held = []

    def batches():
        for _ in range(6):
            held.append(pa.total_allocated_bytes())
            yield pa.RecordBatch.from_arrays([pa.array([a, b], k) for a, b, k in zip(place, answer, kinds, strict=True)], names)

    places, known = pst.received(batches())
    assert len(places) == len(known) == 6
    assert places[0]["docs"].to_pylist() == [[4, 5]] and places[5]["word"] == [big] and known[5]["counts"] == b"c"
    assert held[-1] - held[1] < len(big)
