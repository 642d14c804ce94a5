"""Token files compressed by Re-Pair: frequent pairs of ids become nonterminals, with lengths for random access.

A file holds the documents of one range of doc_id, in ascending order:

    magic "RPG2" | counts: rules, symbols, documents, documents without doc_id (u64) | base (u64: ids below are terminals)
    | left, right of each rule (u32) | ids that each rule stands for (u32) | symbols (u32)
    | doc_id (i64) and ids before it (u64) of each document, those without doc_id first

Each pass counts the pairs of neighbours, gives those that reach the least count a nonterminal and replaces them from
left to right without overlap. A pair that others leave too few places waits. Passes go on until no pair reaches the
least count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridertide.llm.arrays import flat, ranges
from ridertide.llm.tables import arrow_batches, text_bytes
from ridertide.llm.tokens import pieces

FILE, END = "word_bpe_49k.json", 1
MAGIC = b"RPG2"
#: Text that goes into one file.
FILE_BYTES = 6 << 20
#: Least count of a pair: a rule has 12 bytes and saves 4 at each place. Nonterminals of a pass.
LEAST, SLOT_BITS = 4, 17
#: First nonterminal: above every id of the vocabulary.
BASE = 1 << 16
NO_PAIR = np.uint64(2**64 - 1)


@dataclass
class Grammar:
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    base: int = BASE

    def spans(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for."""
        out = np.ones(len(symbols), np.int64)
        rule = np.flatnonzero(symbols >= self.base)
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids behind the symbols: each rule is written out once, then all symbols are looked up together."""
        ids, starts = self.written
        return ids[ranges(starts[symbols], self.spans(symbols))]

    @cached_property
    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the terminals and of all rules one after another, place of each symbol's first id)."""
        lengths = self.lengths.astype(np.int64)
        starts = np.concatenate([np.arange(self.base), self.base + np.cumsum(lengths) - lengths])
        ids = np.empty(self.base + int(lengths.sum()), np.uint32)
        ids[: self.base] = np.arange(self.base)
        size = np.concatenate([np.ones(self.base, np.int64), lengths])
        # A rule is longer than its parts: by length, the parts of each are there before it.
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=0, append=-1))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            rule = order[i:j]
            left, right, to = self.left[rule].astype(np.int64), self.right[rule].astype(np.int64), starts[self.base + rule]
            ids[ranges(to, size[left])] = ids[ranges(starts[left], size[left])]
            ids[ranges(to + size[left], size[right])] = ids[ranges(starts[right], size[right])]
        return ids, starts

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids start .. stop - 1: only the symbols that cover them are expanded."""
        ends = np.cumsum(self.spans(self.symbols))
        i, j = np.searchsorted(ends, [start, stop - 1], side="right")
        skipped = start - (int(ends[i - 1]) if i else 0)
        return self.expand(self.symbols[i : j + 1])[skipped : skipped + stop - start]


def slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def frequent(own: np.ndarray, after: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts) of those at `least` of the live places, ascending by count. own: the pairs at the live places, in
    order; after: is the next live place its neighbour? Places that overlap in a run of one symbol count once."""
    same = (own >> np.uint64(32)) == (own & np.uint64(0xFFFFFFFF))
    if same.any():
        at = np.flatnonzero(same)
        own = np.concatenate([own[~same], own[alternating(at, after)]])
    ordered = np.sort(own)
    first = np.flatnonzero(np.r_[len(ordered) > 0, ordered[1:] != ordered[:-1]])
    counts = np.diff(np.r_[first, len(ordered)])
    often = np.flatnonzero(counts >= least)
    often = often[np.argsort(counts[often], kind="stable")]
    return ordered[first[often]], counts[often]


def alternating(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Every second one of live places that are neighbours in turn, from the left. at: some of the live places' numbers."""
    if not len(at):
        return at
    joined = (np.diff(at) == 1) & after[at[:-1]]
    run = np.flatnonzero(np.r_[True, ~joined])
    nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
    return at[nth % 2 == 0]


def paying(at: np.ndarray, slot: np.ndarray, least: int) -> np.ndarray:
    """The places of pairs that have at least `least` of them."""
    return at[np.bincount(slot[at], minlength=1 << SLOT_BITS)[slot[at]] >= least]


def places(own: np.ndarray, after: np.ndarray, chosen: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(live places to replace, slot of each live place, pair of each slot). The most frequent pair of a slot has it."""
    table = np.full(1 << SLOT_BITS, NO_PAIR)
    table[slots(chosen)] = chosen
    slot = slots(own)
    hit = np.flatnonzero(table[slot] == own)
    place = paying(alternating(hit, after), slot, least)
    if not len(place):
        # Each takes too many places of the others: places go to the more frequent pair, so the first one has all of its.
        rank = np.zeros(1 << SLOT_BITS, np.int64)
        order = np.lexsort([slots(chosen), counts])
        rank[slots(chosen[order])] = np.arange(1, len(order) + 1)
        score = np.zeros(len(own) + 2, np.int64)
        score[hit + 1] = rank[slot[hit]]
        near = np.r_[False, after]
        before = np.where(near[hit], score[hit], 0)
        behind = np.where(near[hit + 1], score[hit + 2], 0)
        beaten = np.maximum(before, behind) > score[hit + 1]
        place = paying(alternating(hit[~beaten], after), slot, least)
    return place, slot, table


def compress(ids: np.ndarray, passes: int | None = None, least: int = LEAST) -> Grammar:
    """passes: at most so many; by default as many as there are pairs for.

    A pair never gains places: after the first pass only the pairs that were frequent and those with a new symbol are
    looked at, so a pass sorts no more than these."""
    symbols, next_rule = ids.astype(np.uint32), BASE
    left, right, lengths = [], [], []
    length_of = np.ones(0, np.int64)
    live = np.arange(max(len(symbols) - 1, 0), dtype=np.int32)
    while len(live) and (passes is None or len(left) < passes):
        own = (symbols[live].astype(np.uint64) << np.uint64(32)) | symbols[live + 1]
        after = np.append(live[1:] - live[:-1] == 1, False)
        chosen, counts = frequent(own, after, least)
        if not len(chosen):
            break
        place, slot, table = places(own, after, chosen, counts, least)
        used, rule = np.unique(slot[place], return_inverse=True)
        pairs = table[used]
        new_left, new_right = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        grown = sum(np.where(x >= BASE, length_of[np.maximum(x.astype(np.int64) - BASE, 0)] if len(length_of) else 1, 1) for x in (new_left, new_right))
        left.append(new_left)
        right.append(new_right)
        lengths.append(grown.astype(np.uint32))
        length_of = np.concatenate([length_of, grown])
        here = live[place]
        symbols[here] = next_rule + rule
        keep = np.ones(len(symbols), bool)
        keep[here + 1] = False
        # Counted again: what was frequent, and the new symbols with the symbols before them.
        again = np.zeros(len(symbols), bool)
        again[live[table[slot] != NO_PAIR]] = True
        again[here] = True
        symbols, again = symbols[keep], again[keep]
        fresh = symbols >= next_rule
        again[:-1] |= fresh[1:]
        live = np.flatnonzero(again[:-1]).astype(np.int32)
        next_rule += len(used)
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.uint32)
    return Grammar(join(left), join(right), join(lengths), symbols)


def to_bytes(grammar: Grammar, doc_ids: np.ndarray, before: np.ndarray, nameless: int = 0) -> bytes:
    """The first `nameless` documents have no doc_id."""
    counts = np.array([len(grammar.left), len(grammar.symbols), len(doc_ids), nameless, grammar.base], "<u8")
    parts = [x.astype("<u4").tobytes() for x in (grammar.left, grammar.right, grammar.lengths, grammar.symbols)]
    return b"".join([MAGIC, counts.tobytes(), *parts, doc_ids.astype("<i8").tobytes(), before.astype("<u8").tobytes()])


def from_bytes(data: bytes) -> tuple[Grammar, np.ndarray, np.ndarray, int]:
    """(grammar, doc_ids, ids before each document, documents without doc_id)."""
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a grammar file")
    rules, symbols, docs, nameless, base = (int(x) for x in np.frombuffer(data, "<u8", 5, 4))
    at, parts = 44, []
    for count, kind in ((rules, "<u4"), (rules, "<u4"), (rules, "<u4"), (symbols, "<u4"), (docs, "<i8"), (docs, "<u8")):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    return Grammar(*parts[:4], base=base), parts[4], parts[5].astype(np.int64), nameless


def file_bounds(docs: DataFrame, file_bytes: int) -> np.ndarray:
    """Largest doc_id of each file but the last: quantiles of doc_id, one for each `file_bytes` of text."""
    files = -(-text_bytes(docs) // file_bytes)
    if files < 2:
        return np.empty(0, np.int64)
    shares = ", ".join(repr(i / files) for i in range(1, files))
    cut = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {max(10_000, 20 * files)})")).first()[0]
    return np.unique(np.array(cut or [], np.int64))


def write_files(docs: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Encode and compress all documents; one row of `path` (file_id, tokens, content) is one file.

    Files are written by Spark's own writer, so that lost tasks leave nothing behind. A null text is empty; a document
    without text has its end id. Rows with a null doc_id come first and stay null. Rows that share a doc_id
    are documents of their own, ordered by their ids' bytes. An empty table yields no file.
    """
    arrow_batches(docs.sparkSession)
    lowest = F.lit(-(2**63))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "text")
    bounds = file_bounds(docs, file_bytes)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("doc_id").to_numpy()
            ids, offsets = pieces(FILE).encode(batch.column("text"), END)
            two = ids.astype("<u2")
            blob = pa.Array.from_buffers(pa.large_binary(), len(key), [None, pa.py_buffer(offsets * 2), pa.py_buffer(two)])
            file_id = pa.array(np.searchsorted(bounds, key, side="left"), pa.int64())
            columns = [file_id, batch.column("named"), batch.column("doc_id"), blob.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["file_id", "named", "doc_id", "ids"])

    def file(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("named", "ascending"), ("doc_id", "ascending"), ("ids", "ascending")])
        data, offsets = flat(rows.column("ids"))
        ids = data.view("<u2") if data.flags.c_contiguous else np.ascontiguousarray(data).view("<u2")
        nameless = rows.num_rows - pa.compute.sum(rows.column("named")).as_py()
        content = to_bytes(compress(ids), rows.column("doc_id").to_numpy(), offsets[:-1] // 2, nameless)
        return pa.table({"file_id": rows.column("file_id")[:1], "tokens": pa.array([len(ids)], pa.int64()), "content": pa.array([content], pa.binary())})

    shares = docs.mapInArrow(encoded, "file_id long, named boolean, doc_id long, ids binary")
    files = shares.groupBy("file_id").applyInArrow(file, "file_id long, tokens long, content binary")
    files.write.option("compression", "zstd").parquet(path)


def read_files(spark, path: str) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    arrow_batches(spark)
    files = spark.read.schema("file_id long, tokens long, content binary").parquet(path)
    # One row a file, without its content.
    before = files.select("file_id", (F.sum("tokens").over(Window.orderBy("file_id")) - F.col("tokens")).alias("before"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(batch.column("file_id"), batch.column("content"), strict=True):
                grammar, doc_id, first, nameless = from_bytes(content.as_buffer())
                ids = grammar.expand(grammar.symbols).astype("<u4")
                ends = np.r_[first[1:], len(ids)]
                raw = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                key = pa.array(doc_id, mask=np.arange(len(doc_id)) < nameless)
                rest = [first, ends - first, np.array(crc, np.int64)]
                columns = [pa.array(np.full(len(doc_id), file_id.as_py())), key, *map(pa.array, rest)]
                yield pa.RecordBatch.from_arrays(columns, ["file_id", "doc_id", "inside", "n_tokens", "ids_crc32"])

    inside = files.select("file_id", "content").mapInArrow(decoded, "file_id long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return inside.join(before, "file_id").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "file_id")

