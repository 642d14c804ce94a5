import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ridertide.llm import grammar
from ridertide.llm.tables import shared_path


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 3), max_size=300), st.integers(1, 9))
def test_round_trip_and_random_access(ids, times):
    ids = np.array(ids * times, np.uint32)
    made = grammar.compress(ids, passes=5, least=2)
    back, doc_ids, before, nameless = grammar.from_bytes(grammar.to_bytes(made, np.array([5]), np.array([0])))
    assert back.expand(back.symbols).tolist() == ids.tolist()
    assert doc_ids.tolist() == [5] and before.tolist() == [0] and nameless == 0
    for a in range(0, len(ids), 17):
        b = min(len(ids), a + 23)
        assert back.read(a, b).tolist() == ids[a:b].tolist()


def test_repetition_shrinks():
    ids = np.tile(np.arange(40, dtype=np.uint32), 200)
    assert len(grammar.compress(ids).symbols) < len(ids) / 8


def left_over(symbols, least):
    """Pairs at `least` places or more that do not overlap."""
    counts, last = {}, {}
    for i, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)):
        if last.get(pair, -2) < i - 1:
            counts[pair] = counts.get(pair, 0) + 1
            last[pair] = i
    return {k: n for k, n in counts.items() if n >= least}


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 3), max_size=300), st.integers(1, 9))
def test_no_frequent_pair_is_left(ids, times):
    ids = np.array(ids * times, np.uint32)
    made = grammar.compress(ids)
    assert made.expand(made.symbols).tolist() == ids.tolist()
    assert not left_over(made.symbols, grammar.LEAST)
    assert 4 * len(made.symbols) + 12 * len(made.left) <= 4 * len(ids)


def test_long_repeats_become_one_symbol():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 40_000, 400)
    ids = np.concatenate([np.r_[passage, rng.integers(0, 40_000, 9)] for _ in range(500)]).astype(np.uint32)
    made = grammar.compress(ids)
    assert made.expand(made.symbols).tolist() == ids.tolist()
    assert made.lengths.max() >= 399
    assert not left_over(made.symbols, grammar.LEAST)


def test_files(spark, odd, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(grammar.FILE))
    odd = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(-(2**63), "least"), (None, "x <|ENDOFTEXT|> y"), (2, "a<|startoftext|>b")], "doc_id long, text string"))
    path = shared_path(spark, "grammar-test")
    grammar.write_files(odd, path, file_bytes=30_000)
    rows = sorted(grammar.read_files(spark, path).collect(), key=lambda r: r["start"])
    assert len({r["file_id"] for r in rows}) > 1
    want = {}
    for r in odd.collect():
        key = r["doc_id"]
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, grammar.END]
        want.setdefault(key, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    every = [k for k, v in want.items() for _ in v]
    assert [r["doc_id"] for r in rows] == sorted(every, key=lambda k: (k is not None, k or 0))
    at = 0
    for r in rows:
        assert r["start"] == at
        assert (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        at += r["n_tokens"]
    path = shared_path(spark, "grammar-test")
    grammar.write_files(empty, path)
    assert grammar.read_files(spark, path).count() == 0
