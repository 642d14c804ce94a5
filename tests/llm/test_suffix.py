import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridertide.llm import suffix


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=200))
def test_suffix_array_and_common_prefixes(values):
    data = np.array(values, np.uint8)
    order, rank = suffix.suffix_array(data)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    assert rank[order].tolist() == list(range(len(raw)))

    def shared(i, j):
        k = 0
        while max(i, j) + k < len(raw) and raw[i + k] == raw[j + k]:
            k += 1
        return k

    want = [0] + [shared(order[i - 1], order[i]) for i in range(1, len(raw))]
    assert suffix.common_prefixes(data, order, rank).tolist() == want


def brute(rows):
    length, first, out = suffix.LENGTH, {}, []
    key = lambda i: -(2**63) if i is None else i
    for i, text in sorted(rows, key=lambda r: key(r[0])):
        raw = (text or "").encode()
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], key(i))
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < key(i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("shard_bytes", [suffix.SHARD_BYTES, 9000])
def test_same_as_brute_force(odd, shard_bytes):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = suffix.removed(odd, shard_bytes, shard_bytes // 2).collect()
    assert order(got) == order(brute(rows))


def probes_of(rows):
    ids = pa.array([-1 if r["doc_id"] is None else r["doc_id"] for r in rows], pa.int64())
    texts = pa.array([(r["text"] or "").encode() for r in rows], pa.binary())
    shard = suffix.Shard(pa.table({"doc_id": ids, "text": texts}), pa.table({"doc_id": pa.array([], pa.int64())}))
    return [x.tolist() for x in shard.probes()]


def test_long_texts_are_cut_without_loss(odd, monkeypatch):
    rows = odd.collect()
    whole = probes_of(rows)
    for name, size in (("CHUNK", 700), ("BLOCK_BYTES", 1500)):
        monkeypatch.setattr(suffix, name, size)
    assert probes_of(rows) == whole


def test_empty(empty):
    assert suffix.removed(empty).count() == 0


def shard_rows(seed: int, passage: bytes) -> pa.Table:
    rng = np.random.default_rng(seed)
    texts = [b"", b"short", b"y" * 50, b"z" * 400]
    for k in range(12):
        own = rng.integers(97, 123, 2000 + 37 * k).astype(np.uint8).tobytes()
        texts.append(own[:900] + passage + own[900:] if k % 3 == 0 else own)
    return pa.table({"shard": [seed] * len(texts), "doc_id": [100 * seed + k for k in range(len(texts))], "text": pa.array(texts, pa.binary())})


NO_COPIES = pa.table({"doc_id": pa.array([], pa.int64())})


def test_runs_of_strings_with_one_anchor(monkeypatch):
    """Every whole string is in one run, with the least hash of its probes; also where texts are cut."""
    rows = shard_rows(1, b"shared " * 30)
    shard = suffix.Shard(rows, NO_COPIES)
    probe = suffix.probe_hashes(shard.data)
    want = {}
    for k, (a, b) in enumerate(zip(shard.offsets[:-1], shard.offsets[1:], strict=True)):
        for i in range(a, b - suffix.LENGTH + 1):
            want[i] = (int(probe[i : i + suffix.LENGTH - suffix.PROBE + 1].min()), k)
    for size in (suffix.CHUNK, 333):
        monkeypatch.setattr(suffix, "CHUNK", size)
        begin, each, hashed, doc = suffix.Shard(rows, NO_COPIES).runs()
        got = [(i, (int(h), int(k))) for a, n, h, k in zip(begin, each, hashed, doc, strict=True) for i in range(a, a + n)]
        assert got == sorted(want.items())


def test_anchors_met_elsewhere():
    bodies = [[5, 9, 5, 1], [2, 7], [9, 2, 3], []]
    rows = [(k, 0, np.array(b, "<u4").tobytes(), b"", b"") for k, b in enumerate(bodies)]
    found = suffix.met_elsewhere(suffix.table(rows, suffix.ROW))
    bits = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(b)).tolist() for x, b in zip(found.column("body"), bodies, strict=True)]
    assert bits == [[0, 1, 0, 0], [1, 0], [1, 1, 0], []]


def test_hashes_of_strings_near_and_far_apart():
    data = np.random.default_rng(1).integers(0, 255, 5000).astype(np.uint8)
    at = np.sort(np.random.default_rng(2).choice(4900, 90, replace=False))
    assert (suffix.string_hashes(data, at) == suffix.string_hashes(data, np.arange(4900))[at]).all()


def test_a_task_hashes_its_text_once(monkeypatch):
    """What shares an anchor is found from the hashes that give the anchors."""
    rows = shard_rows(3, b"a passage of several documents, longer than one string of fifty bytes")
    bits = suffix.met_elsewhere(suffix.probe_arrays(rows, NO_COPIES, 1)).append_column("doc_id", pa.nulls(1, pa.int64()))
    hashed = []
    eights = suffix.eights
    monkeypatch.setattr(suffix, "eights", lambda data: hashed.append(len(data)) or eights(data))
    out = suffix.context_arrays(rows, bits, 1)
    assert out.column("kind").to_pylist().count(1) == 4
    assert sum(hashed) < 1.2 * sum(len(x) for x in rows.column("text").to_pylist())
