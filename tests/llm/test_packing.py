import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ridertide.llm import packing


def ids_of(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.FILE))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


@pytest.mark.parametrize("capacity", [1024, 64])
def test_pieces_are_whole_and_fit(spark, odd, capacity):
    more = spark.createDataFrame([(-1, "minus one"), (0, "a <|endoftext|> b"), (None, "<|endoftext|>")], "doc_id long, text string")
    odd = odd.select("doc_id", "text").unionByName(more)
    rows = packing.packed(odd, capacity=capacity, group=40).collect()
    want = [(r["doc_id"], ids_of(r["text"])) for r in odd.collect()]
    assert ids_of("a <|endoftext|> b") == [64, 220, 50256, 275, 0]
    seen = {}
    for r in rows:
        seen.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    by_id = {}
    for doc_id, ids in want:
        by_id.setdefault((doc_id, len(ids)), []).append(ids)
    assert seen.keys() == by_id.keys()
    for key, pieces in seen.items():
        copies = by_id[key]
        for r in pieces:
            part = copies[0][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        places = sorted(x for r in pieces for x in range(r["start"], r["start"] + r["length"]))
        assert places == sorted(list(range(key[1])) * len(copies))
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    used = sum(r["length"] for r in rows)
    # A task rounds up by one window; the rest is padding between nearly equal windows.
    assert len(windows) <= used / capacity * 1.1 + 4


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=80))
def test_differencing_keeps_sizes_and_capacity(sizes):
    sizes = np.array(sizes)
    window, count = packing.windows_for(sizes, 1024)
    sums = np.bincount(window, weights=sizes, minlength=count)
    assert len(sums) == count and sums.max() <= 1024
    assert count <= -(-sizes.sum() // 1024) + max(2, sizes.sum() // 4096)


def test_differencing_balances():
    sizes = np.random.default_rng(1).integers(1, 257, 2000)
    window, count = packing.windows_for(sizes, 1024)
    assert count * 1024 <= sizes.sum() * 1.02 + 1024
    sums = np.bincount(window, weights=sizes)
    assert sums.max() - sums.min() <= 40


def test_empty(empty):
    assert packing.packed(empty).count() == 0


def test_a_task_leaves_no_pieces_in_its_worker():
    texts = [f"word{i} and others{i % 7}" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    rows = pa.Table.from_batches(packing.pack(iter([batch, batch]), 64, 16, 100))
    assert rows.num_rows >= 600 and not packing.pieces(packing.FILE).known
