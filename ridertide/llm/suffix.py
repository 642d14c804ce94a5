"""Exact removal of repeated byte strings by suffix arrays of shards, merged by binary search.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id. Steps:

1. Shards are sets of documents, dealt by a hash of doc_id. Each shard marks content-defined anchors: the smallest
   hash of a PROBE-byte string in each LENGTH-byte window. A string that two documents share has the same anchors in
   both, so only text around anchors that several documents have can matter. Shards exchange their distinct anchors as
   sorted arrays, by range of the hash; what comes back is one bit for each.
2. Neighbouring strings with the same anchor form a context. Shards exchange the hashes of their distinct contexts. A
   context that a smaller document has goes whole; where all documents have an anchor in the same context, its strings
   are settled too. What is left are strings under anchors with several contexts, as at the edges of copied passages.
3. Each shard sorts the suffixes of the text under those strings (Larsson-Sadakane refinement), takes common prefixes of
   neighbours (Kasai, in the form that fills the text order from the few entries where a run starts), and so finds the
   strings it has twice, with the smallest doc_id of each. Shards exchange their distinct strings as sorted arrays by
   range; a merge looks each array up in the others by binary search, and one bit comes back for each string: is there
   a smaller document elsewhere?
4. Bytes are dropped.

All that crosses shards is arrays of a bounded part of the shards' sizes; a string that every document has is one
entry for each shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridertide.llm.arrays import flat, mixed, ranges
from ridertide.llm.tables import arrow_batches, discard, discard_folder, release, shared_path, stage, text_bytes

LENGTH, PROBE = 50, 32
#: Text for each shard and for each range of hashes: what a task holds.
SHARD_BYTES, RANGE_BYTES = 6 << 20, 12 << 20
#: Bytes that are sorted at once, hashed at once, and the longest part of a text in either.
SORT_BYTES, BLOCK_BYTES, CHUNK = 1 << 20, 1 << 17, 1 << 20
#: Strings of a context.
SPAN = 32
#: Between stretches of text: never part of UTF-8.
BREAK = 0xFF


# Hashes of all fixed-length strings of a text, by doubling. The first eight bytes are taken as they are.


def eights(data: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)


def joined(a: np.ndarray, shift: int) -> np.ndarray:
    """From hashes of strings: hashes of each string and the one that starts `shift` later."""
    later = np.zeros_like(a)
    if shift < len(a):
        later[:-shift] = a[shift:]
    return mixed(a * np.uint64(3) + later)


def probe_hashes(data: np.ndarray) -> np.ndarray:
    """Of PROBE bytes from each position; meaningless where the text ends sooner."""
    return joined(joined(mixed(eights(data)), 8), 16)


def hashes(data: np.ndarray) -> np.ndarray:
    """Of LENGTH bytes from each position; meaningless where the text ends sooner."""
    return joined(probe_hashes(data), LENGTH - PROBE)


def least_of(a: np.ndarray, width: int) -> np.ndarray:
    """The minimum of a[i .. i + width - 1], shorter at the end."""
    out, have = a, 1
    while have < width:
        step = min(have, width - have)
        wider = out.copy()
        if step < len(out):
            np.minimum(out[:-step], out[step:], out=wider[:-step])
        out, have = wider, have + step
    return out


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first position, number, hash of the anchor, text) of the runs of LENGTH-byte strings with one anchor. Texts
    aren't empty."""
    least = least_of(probe_hashes(data), LENGTH - PROBE + 1)
    new = np.ones(len(data), bool)
    new[1:] = least[1:] != least[:-1]
    new[offsets[:-1]] = True
    first = np.flatnonzero(new)
    text = np.searchsorted(offsets, first, side="right") - 1
    # Strings start only where LENGTH bytes of the text are left.
    size = np.minimum(np.r_[first[1:], len(data)], offsets[text + 1] - LENGTH + 1) - first
    some = size > 0
    return first[some], size[some], least[first[some]], text[some]


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of true flags."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# Suffix array and common prefixes of one run of bytes.


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) by Larsson-Sadakane: suffixes are ordered by eight bytes, then groups that are still equal
    are split by the rank of the suffix 8, 16, 32, ... bytes on; groups of one are left alone."""
    n = len(data)
    keys = eights(data)
    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    sizes = np.diff(np.r_[starts, n])
    # The rank of a group is its last place.
    rank[order] = np.repeat(starts + sizes - 1, sizes)
    open_ = np.repeat(sizes > 1, sizes)
    places = np.flatnonzero(open_)
    h = 8
    while len(places):
        suffixes = order[places]
        group = rank[suffixes]
        # What ends sooner comes first.
        after = np.where(suffixes + h < n, rank[np.minimum(suffixes + h, n - 1)], n - 1 - suffixes - h)
        both = group * (2 * n + h) + (after + n + h)
        new = np.argsort(both)
        suffixes, both = suffixes[new], both[new]
        order[places] = suffixes
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        sizes = np.diff(np.r_[first, len(places)])
        rank[suffixes] = np.repeat(places[first + sizes - 1], sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[i]: bytes that suffixes order[i - 1] and order[i] share; lcp[0] is 0.

    In text order the value falls by at most one from a position to the next (Kasai). It is counted only at positions
    whose preceding byte differs from that of the neighbour; all others continue the run."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    prior = before
    inner = (here > 0) & (prior > 0)
    starts = np.ones(n, bool)
    starts[inner] = data[here[inner] - 1] != data[prior[inner] - 1]
    at = np.flatnonzero(starts & (prior >= 0))
    keys = eights(data)
    a, b = at.copy(), prior[at].copy()
    live = np.arange(len(at))
    while len(live):
        x = keys[np.minimum(a[live], n - 1)] ^ keys[np.minimum(b[live], n - 1)]
        over = (a[live] + 8 > n) | (b[live] + 8 > n)
        same = (x == 0) & ~over
        done = live[~same]
        # The last eight bytes: those before the first difference, not past the end.
        rest = x[~same]
        # Without the bit below it, the highest bit isn't rounded up.
        highest = np.frexp((rest & ~(rest >> np.uint64(1))).astype(np.float64))[1]
        left = np.minimum(n - a[done], n - b[done])
        step = np.minimum((64 - highest) // 8, np.maximum(left, 0))
        a[done] += step
        b[done] += step
        live = live[same]
        a[live] += 8
        b[live] += 8
    reach = np.zeros(n, np.int64)
    reach[at] = a
    # a is where the common prefix of a start ends; it never ends sooner for later positions of the run.
    ends = np.maximum.accumulate(reach)
    plcp = np.maximum(ends - here, 0)
    plcp[prior < 0] = 0
    return plcp[order]


def repeated(data: np.ndarray, docs: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, smallest doc) of the distinct LENGTH-byte strings at the valid positions of one run of bytes."""
    order, rank = suffix_array(data)
    lcp = common_prefixes(data, order, rank)
    ok = valid[order]
    at, group = order[ok], np.cumsum(lcp < LENGTH)[ok]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(at) else np.empty(0, np.int64)
    least = np.minimum.reduceat(docs[at], first) if len(at) else np.empty(0, np.int64)
    return at[first], least


# Shards.


class Shard:
    """Documents of one shard, in ascending order of doc_id, without the texts that are copies of smaller documents."""

    def __init__(self, rows: pa.Table, copies: pa.Table):
        rows = rows.sort_by([("doc_id", "ascending")])
        self.all_ids = rows.column("doc_id").to_numpy()
        self.data, self.offsets = flat(rows.column("text"))
        self.is_copy = np.isin(self.all_ids, copies.column("doc_id").to_numpy())
        lengths = np.diff(self.offsets)
        # Long texts are cut into chunks that share LENGTH - 1 bytes: each window lies in one of them.
        step = CHUNK - LENGTH + 1
        count = np.where(self.is_copy | (lengths < LENGTH), 0, np.maximum(1, -(-(lengths - LENGTH + 1) // step)))
        self.chunk_doc = np.repeat(np.arange(len(lengths)), count)
        inside = ranges(np.zeros(len(count), np.int64), count) * step
        self.chunk_start = self.offsets[:-1][self.chunk_doc] + inside
        self.chunk_size = np.minimum(CHUNK, self.offsets[1:][self.chunk_doc] - self.chunk_start)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, offsets, place in the shard of each chunk, doc of each chunk) of some chunks at a time."""
        group = (np.cumsum(self.chunk_size) - 1) // BLOCK_BYTES if len(self.chunk_size) else np.empty(0, np.int64)
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            start, size = self.chunk_start[a:b], self.chunk_size[a:b]
            data = np.concatenate([self.data[i : i + n] for i, n in zip(start.tolist(), size.tolist(), strict=True)])
            yield data, np.r_[0, np.cumsum(size)], start, self.chunk_doc[a:b]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of the first, number, hash of the anchor, doc) of the runs of strings with one anchor, in order."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))]
        for data, offsets, start, doc in self.blocks():
            first, size, hashed, chunk = anchored(data, offsets)
            found.append((start[chunk] + first - offsets[chunk], size, hashed, doc[chunk]))
        begin, size, hashed, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        return begin, size, hashed, doc

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct hashes of anchors, is it in several documents of the shard), ascending."""
        _, _, hashed, doc = self.runs()
        return distinct_anchors(hashed, doc)[:2]


def distinct_anchors(hashed: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, is it in several documents), ascending, and which of them each hash is."""
    if not len(hashed):
        return hashed, np.empty(0, bool), np.empty(0, np.int64)
    order = np.argsort(hashed)
    ranked, doc = hashed[order], doc[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return ranked[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), which


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    ranked = np.sort(values)
    return ranked[np.r_[True, ranked[1:] != ranked[:-1]]] if len(ranked) else ranked


def range_of(hashed: np.ndarray, count: int) -> np.ndarray:
    """Which of `count` equal ranges a hash lies in."""
    return ((hashed >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def by_range(hashed: np.ndarray, count: int) -> Iterator[tuple[int, slice]]:
    """The slices of ascending hashes that lie in each range."""
    number = range_of(hashed, count)
    edges = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(number) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(number[a]), slice(int(a), int(b))


ROW = "shard long, part long, body binary, docs binary, ids binary"
DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
STAGED = f"kind int, {ROW}, {DONE.removeprefix('doc_id long, ')}"


def table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split(" ") for f in names.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(column, kinds[kind]) for (name, kind), column in zip(fields, columns, strict=True)})


def probe_arrays(rows: pa.Table, copies: pa.Table, count: int) -> pa.Table:
    """The low halves of a shard's anchors, by range of the hash."""
    shard = rows.column("shard")[0].as_py() if len(rows) else 0
    hashed = distinct(Shard(rows, copies).runs()[2]) if len(rows) else np.empty(0, np.uint64)
    low = hashed.astype("<u4")
    return table([(shard, part, low[s].tobytes(), b"", b"") for part, s in by_range(hashed, count)], ROW)


def met_elsewhere(rows: pa.Table) -> pa.Table:
    """For each shard's array of anchors a bit: has another shard the same?"""
    arrays = [np.frombuffer(x.as_buffer(), "<u4") for x in rows.column("body")]
    merged, owner = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
    order = np.argsort(merged)
    ranked, owner = merged[order], owner[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    first = np.flatnonzero(new)
    several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
    met = np.empty(len(merged), bool)
    met[order] = several[np.cumsum(new) - 1]
    edges = np.cumsum([0, *map(len, arrays)])
    bits = [np.packbits(met[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    shards, parts = rows.column("shard").to_pylist(), rows.column("part").to_pylist()
    return table([(s, p, b, b"", b"") for s, p, b in zip(shards, parts, bits, strict=True)], ROW)


def answers(hashed: np.ndarray, bits: pa.Table, count: int) -> np.ndarray:
    """The bits that came back, in the order of the shard's ascending hashes."""
    back = {p.as_py(): b for p, b in zip(bits.column("part"), bits.column("body"), strict=True)}
    out = np.zeros(len(hashed), bool)
    for part, s in by_range(hashed, count):
        n = s.stop - s.start
        out[s] = np.unpackbits(np.frombuffer(back[part].as_buffer(), np.uint8), count=n).astype(bool)
    return out


def candidates(shard: Shard, bits: pa.Table, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of the shard's strings (place of the first, number, anchor, doc) whose anchor several documents have."""
    begin, size, hashed, doc = shard.runs()
    distinct, local, which = distinct_anchors(hashed, doc)
    hit = (local | answers(distinct, bits, count))[which]
    return begin[hit], size[hit], hashed[hit], doc[hit]


def contexts(data: np.ndarray, at: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each context in `at`, hash of each) for starts of strings at ascending positions.

    A context is a run of neighbouring starts of one document with the same anchor, at most SPAN of them, so that its
    first and last string cover it."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    new = np.r_[True, (np.diff(at) != 1) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    first = np.flatnonzero(inside % SPAN == 0)
    last = np.r_[first[1:], len(at)] - 1
    size = (last - first).astype(np.uint64)
    return first, mixed(mixed(string_hashes(data, at[first]) + size) * np.uint64(3) + string_hashes(data, at[last]))


def distinct_contexts(anchor: np.ndarray, context: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, hash, smallest doc) of the distinct contexts, ascending, and which of them each context is."""
    order = np.lexsort([doc, context, anchor])
    a, c = anchor[order], context[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])] if len(a) else np.empty(0, bool)
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    return anchor[first], context[first], doc[first], which


def string_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the LENGTH-byte strings at ascending positions, without hashing the text between."""
    if not len(at):
        return np.empty(0, np.uint64)
    out = np.empty(len(at), np.uint64)
    for a in range(0, len(at), BLOCK_BYTES):
        part = at[a : a + BLOCK_BYTES]
        first, last = int(part[0]), int(part[-1]) + LENGTH
        if last - first <= 4 * len(part):
            out[a : a + len(part)] = hashes(data[first:last])[part - first]
        else:
            eight = lambda k: np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))[part + k].astype(np.uint64)  # noqa: B023, E731
            sixteen = lambda k: mixed(mixed(eight(k)) * np.uint64(3) + mixed(eight(k + 8)))  # noqa: B023, E731
            probe = lambda k: mixed(sixteen(k) * np.uint64(3) + sixteen(k + 16))  # noqa: B023, E731
            out[a : a + len(part)] = mixed(probe(0) * np.uint64(3) + probe(LENGTH - PROBE))
    return out


def sorted_strings(shard: Shard, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, smallest doc) of the distinct candidate strings of a shard, ascending.

    The text under the candidates is sorted, SORT_BYTES at a time; equal strings of several sorts meet by their hash."""
    begin, end = runs_of(starts)
    doc = np.searchsorted(shard.offsets, begin, side="right") - 1
    # A run of starts ends with its document; long ones are cut.
    cut = -(-(end - begin) // CHUNK)
    run = np.repeat(np.arange(len(begin)), cut)
    begin = begin[run] + ranges(np.zeros(len(cut), np.int64), cut) * CHUNK
    end = np.minimum(begin + CHUNK, end[run])
    size = end - begin + LENGTH
    group = (np.cumsum(size) - 1) // SORT_BYTES if len(size) else np.empty(0, np.int64)
    found, least = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for g in np.unique(group):
        pick = group == g
        place = ranges(begin[pick], size[pick])
        ends = np.cumsum(size[pick])
        data = shard.data[np.minimum(place, len(shard.data) - 1)]
        data[ends - 1] = BREAK
        valid = np.arange(len(data)) <= np.repeat(ends - 1 - LENGTH, size[pick])
        at, small = repeated(data, np.repeat(doc[run[pick]], size[pick]), valid)
        ascending = np.argsort(at)
        at, small = at[ascending], small[ascending]
        found.append(string_hashes(data, at))
        least.append(small)
    hashed, small = np.concatenate(found), np.concatenate(least)
    order = np.argsort(hashed, kind="stable")
    hashed, small = hashed[order], small[order]
    first = np.flatnonzero(np.r_[True, hashed[1:] != hashed[:-1]]) if len(hashed) else np.empty(0, np.int64)
    return hashed[first], np.minimum.reduceat(small, first) if len(first) else small


def done(number: int, doc_id: int, text: bytes, removed: np.ndarray | None) -> tuple:
    """A finished document. removed: marks of its bytes, None if nothing goes."""
    if removed is None:
        digest = hashlib.sha256(text).hexdigest()
        return (2, number, doc_id, b"", b"", b"", len(text), 0, 0, digest)
    digest = hashlib.sha256(np.frombuffer(text, np.uint8)[~removed].tobytes()).hexdigest()
    return (2, number, doc_id, b"", b"", b"", len(text), int(removed.sum()), len(runs_of(removed)[0]), digest)


def covered(size: int, starts: np.ndarray) -> np.ndarray:
    """Bytes under the strings that start at the given different positions."""
    cover = np.zeros(size + 1, np.int32)
    cover[starts] += 1
    cover[starts + LENGTH] -= 1
    return np.cumsum(cover[:-1]) > 0


def context_arrays(rows: pa.Table, bits: pa.Table, count: int) -> pa.Table:
    """Of a shard: its distinct contexts by range (kind 0); documents with candidates, their text, the starts and their
    anchors (kind 1); documents that are done (kind 2)."""
    if not len(rows):
        return table([], STAGED)
    number = rows.column("shard")[0].as_py()
    copies = bits.filter(pa.compute.equal(bits.column("part"), -1))
    shard = Shard(rows, pa.table({"doc_id": copies.column("doc_id")}))
    begin, size, hashed, owner = candidates(shard, bits, count)
    at, named, doc = ranges(begin, size), np.repeat(hashed, size), np.repeat(owner, size)
    first, context = contexts(shard.data, at, named, doc)
    anchor, context, small, _ = distinct_contexts(named[first], context, doc[first])
    ids, out = shard.all_ids, []
    for part, s in by_range(anchor, count):
        body = np.stack([anchor[s], context[s]]).astype("<u8").tobytes()
        out.append((0, number, part, body, ids[small[s]].astype("<i8").tobytes(), b"", None, None, None, None))
    edges = np.searchsorted(begin, shard.offsets)
    for k, doc_id in enumerate(ids.tolist()):
        text = shard.data[shard.offsets[k] : shard.offsets[k + 1]].tobytes()
        a, b = edges[k], edges[k + 1]
        if shard.is_copy[k] and len(text) >= LENGTH:
            out.append(done(number, doc_id, text, np.ones(len(text), bool)))
        elif shard.is_copy[k] or a == b:
            out.append(done(number, doc_id, text, None))
        else:
            # Anchors by run of strings: each is written once.
            start = begin[a:b] - shard.offsets[k]
            runs = np.stack([start, start + size[a:b]]).astype("<i8").tobytes()
            out.append((1, number, doc_id, text, runs, hashed[a:b].astype("<u8").tobytes(), None, None, None, None))
    return table(out, STAGED)


def settled(rows: pa.Table) -> pa.Table:
    """For each shard's array of contexts two rows of bits: has a smaller document the context? Has its anchor others?"""
    parts = [np.frombuffer(x.as_buffer(), "<u8").reshape(2, -1) for x in rows.column("body")]
    owners = [np.frombuffer(x.as_buffer(), "<i8") for x in rows.column("docs")]
    anchor, context, least, which = distinct_contexts(*(np.concatenate([x[k] for x in parts]) for k in (0, 1)), np.concatenate(owners))
    several = np.zeros(len(anchor), bool)
    same = anchor[1:] == anchor[:-1]
    several[1:] |= same
    several[:-1] |= same
    out, base = [], 0
    for shard, part, owner in zip(rows.column("shard").to_pylist(), rows.column("part").to_pylist(), owners, strict=True):
        own = which[base : base + len(owner)]
        base += len(owner)
        out.append((shard, part, np.packbits([least[own] < owner, several[own]], axis=1).tobytes(), b"", b""))
    return table(out, ROW)


class Open:
    """Documents of a shard that have candidates, as they were staged, in ascending order of doc_id."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("part", "ascending")])
        self.ids = rows.column("part").to_numpy()
        self.data, self.offsets = flat(rows.column("body"))
        at, anchor, doc = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for k, (runs, named) in enumerate(zip(rows.column("docs"), rows.column("ids"), strict=True)):
            begin, end = np.frombuffer(runs.as_buffer(), "<i8").reshape(2, -1)
            at.append(ranges(begin, end - begin) + self.offsets[k])
            anchor.append(np.repeat(np.frombuffer(named.as_buffer(), "<u8"), end - begin))
            doc.append(np.full(len(at[-1]), k))
        self.at, self.anchor, self.doc = np.concatenate(at), np.concatenate(anchor), np.concatenate(doc)

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def string_arrays(rows: pa.Table, bits: pa.Table, count: int) -> pa.Table:
    """Of a shard's open documents: the distinct strings that contexts left open, by range (kind 0); documents with
    such strings, their text, the starts of strings, and bits for those that are open and those that go (kind 1);
    documents that are done (kind 2)."""
    if not len(rows):
        return table([], STAGED)
    number = rows.column("shard")[0].as_py()
    docs = Open(rows)
    first, context = contexts(docs.data, docs.at, docs.anchor, docs.doc)
    anchor, context, small, which = distinct_contexts(docs.anchor[first], context, docs.doc[first])
    back = {p.as_py(): b for p, b in zip(bits.column("part"), bits.column("body"), strict=True)}
    smaller, several = np.zeros(len(anchor), bool), np.zeros(len(anchor), bool)
    for part, s in by_range(anchor, count):
        n = s.stop - s.start
        two = np.unpackbits(np.frombuffer(back[part].as_buffer(), np.uint8).reshape(2, -1), axis=1, count=n).astype(bool)
        smaller[s], several[s] = two
    size = np.diff(np.r_[first, len(docs.at)])
    own = docs.ids[docs.doc[first]]
    gone = np.repeat(smaller[which] | (docs.ids[small[which]] < own), size)
    left = np.repeat(several[which], size) & ~gone
    marks = np.zeros(len(docs.data), bool)
    marks[docs.at[left]] = True
    hashed, least = sorted_strings(docs, marks)
    out = []
    for part, s in by_range(hashed, count):
        arrays = hashed[s].astype("<u8").tobytes(), docs.ids[least[s]].astype("<i8").tobytes(), b""
        out.append((0, number, part, *arrays, None, None, None, None))
    if left.any():
        where = np.searchsorted(hashed, string_hashes(docs.data, docs.at[left]))
        local = docs.ids[least[where]] < docs.ids[docs.doc[left]]
        still = np.flatnonzero(left)
        gone[still[local]] = True
    edges = np.searchsorted(docs.at, docs.offsets)
    for k, doc_id in enumerate(docs.ids.tolist()):
        text, part = docs.text(k), slice(int(edges[k]), int(edges[k + 1]))
        at = docs.at[part] - docs.offsets[k]
        if (left[part] & ~gone[part]).any():
            flags = np.packbits([left[part], gone[part]], axis=1).tobytes()
            begin, end = runs_of_positions(at)
            out.append((1, number, doc_id, text, np.stack([begin, end]).astype("<i8").tobytes(), flags, None, None, None, None))
        else:
            out.append(done(number, doc_id, text, covered(len(text), at[gone[part]])))
    return table(out, STAGED)


def runs_of_positions(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of consecutive numbers."""
    first = np.flatnonzero(np.r_[True, np.diff(at) != 1]) if len(at) else np.empty(0, np.int64)
    return at[first], at[np.r_[first[1:], len(at)] - 1] + 1 if len(at) else at


def looked_up(hashed: np.ndarray, bits: pa.Table, count: int) -> np.ndarray:
    """Does a smaller document have the string? For some of a shard's strings: bits came back with the strings."""
    back = {p.as_py(): k for k, p in enumerate(bits.column("part"))}
    out = np.zeros(len(hashed), bool)
    for part, s in by_range(hashed, count):
        k = back[part]
        known = np.frombuffer(bits.column("docs")[k].as_buffer(), "<u8")
        said = np.unpackbits(np.frombuffer(bits.column("body")[k].as_buffer(), np.uint8), count=len(known)).astype(bool)
        out[s] = said[np.searchsorted(known, hashed[s])]
    return out


def smaller_elsewhere(rows: pa.Table) -> pa.Table:
    """For each shard's array of strings a bit: has a smaller document of any shard the string?"""
    arrays = [np.frombuffer(x.as_buffer(), "<u8") for x in rows.column("body")]
    owners = [np.frombuffer(x.as_buffer(), "<i8") for x in rows.column("docs")]
    merged, owner = np.concatenate(arrays), np.concatenate(owners)
    order = np.argsort(merged, kind="stable")
    merged, owner = merged[order], owner[order]
    first = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]])
    distinct, least = merged[first], np.minimum.reduceat(owner, first)
    bits = [np.packbits(least[np.searchsorted(distinct, x)] < o).tobytes() for x, o in zip(arrays, owners, strict=True)]
    shards, parts = rows.column("shard").to_pylist(), rows.column("part").to_pylist()
    return table([(s, p, b, x.tobytes(), b"") for s, p, b, x in zip(shards, parts, bits, arrays, strict=True)], ROW)


def cleaned(rows: pa.Table, bits: pa.Table, count: int) -> pa.Table:
    """The documents with open strings: bytes under a string that a smaller document has go."""
    if not len(rows):
        return table([], DONE)
    rows = rows.sort_by([("part", "ascending")])
    data, offsets = flat(rows.column("body"))
    starts, left, gone = [], [], []
    for k, (runs, flags) in enumerate(zip(rows.column("docs"), rows.column("ids"), strict=True)):
        begin, end = np.frombuffer(runs.as_buffer(), "<i8").reshape(2, -1)
        starts.append(ranges(begin, end - begin) + offsets[k])
        two = np.unpackbits(np.frombuffer(flags.as_buffer(), np.uint8).reshape(2, -1), axis=1, count=len(starts[-1]))
        left.append(two[0].astype(bool))
        gone.append(two[1].astype(bool))
    at, left, gone = np.concatenate(starts), np.concatenate(left), np.concatenate(gone)
    distinct, place = np.unique(string_hashes(data, at[left]), return_inverse=True)
    gone[left] |= looked_up(distinct, bits, count)[place]
    edges, out = np.searchsorted(at, offsets), []
    for k, doc_id in enumerate(rows.column("part").to_pylist()):
        part = slice(int(edges[k]), int(edges[k + 1]))
        text = data[offsets[k] : offsets[k + 1]].tobytes()
        marks = covered(len(text), at[part][gone[part]] - offsets[k])
        out.append((doc_id, *done(0, doc_id, text, marks)[6:]))
    return table(out, DONE)


def removed(docs: DataFrame, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A null text is empty. Documents shorter than LENGTH bytes stay as they are. A null doc_id counts as the smallest.
    Rows that share a doc_id don't remove each other's text. Of documents with the same text the smallest stays and
    is searched; the others go whole without being sorted. An empty table stays empty. Strings of different shards are
    compared by a 64-bit hash, within a shard by their bytes.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    total = text_bytes(docs)
    shards, count = max(1, -(-total // shard_bytes)), max(1, -(-total // range_bytes))
    lowest = F.lit(-(2**63)).cast("long")
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), lowest).alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")
    texts = base.select(shard, "doc_id", "text")
    # Copies of a text in a larger doc_id. Rows that repeat the smallest doc_id are no copies.
    digests = base.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    least = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = stage(digests.join(least, "digest").where("doc_id > first").select(shard, "doc_id").distinct())

    def probed(left: pa.Table, right: pa.Table) -> pa.Table:
        return probe_arrays(left, right, count)

    def grouped(left: pa.Table, right: pa.Table) -> pa.Table:
        return context_arrays(left, right, count)

    def sorted_(left: pa.Table, right: pa.Table) -> pa.Table:
        return string_arrays(left, right, count)

    def dropped(left: pa.Table, right: pa.Table) -> pa.Table:
        return cleaned(left, right, count)

    def written(found: DataFrame, path: str) -> DataFrame:
        found.write.option("compression", "zstd").partitionBy("kind").parquet(path)
        release(spark)
        return spark.read.schema(STAGED).parquet(path)

    def of_kind(found: DataFrame, kind: int) -> DataFrame:
        return found.where(F.col("kind") == kind).drop("kind")

    def done_with(path: str, *kinds: int) -> None:
        """Nothing reads these kinds any more: each is a folder of its own."""
        for kind in kinds:
            discard_folder(spark, f"{path}/kind={kind}")
        release(spark)

    by_context, by_string = shared_path(spark, "contexts"), shared_path(spark, "strings")

    arrays = texts.groupBy("shard").cogroup(copies.groupBy("shard")).applyInArrow(probed, ROW)
    met = stage(arrays.groupBy("part").applyInArrow(met_elsewhere, ROW))
    del arrays
    release(spark)
    told = met.select("shard", "part", "body", F.lit(None).cast("long").alias("doc_id")).unionByName(
        copies.select("shard", F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("body"), "doc_id")
    )
    found = written(texts.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(grouped, STAGED), by_context)
    discard(met)
    known = stage(of_kind(found, 0).groupBy("part").applyInArrow(settled, ROW))
    open_ = of_kind(found, 1).groupBy("shard").cogroup(known.groupBy("shard"))
    strings = written(open_.applyInArrow(sorted_, STAGED), by_string)
    discard(known)
    done_with(by_context, 0, 1)
    decided = stage(of_kind(strings, 0).groupBy("part").applyInArrow(smaller_elsewhere, ROW))
    done_with(by_string, 0)
    closed = of_kind(strings, 1).groupBy("shard").cogroup(decided.groupBy("shard")).applyInArrow(dropped, DONE)
    columns = [F.col("part").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    done_ = of_kind(found, 2).select(columns).unionByName(of_kind(strings, 2).select(columns))
    return closed.unionByName(done_).withColumn("doc_id", F.nullif("doc_id", lowest))
