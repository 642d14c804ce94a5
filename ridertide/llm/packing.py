"""Packing documents into windows by multiway Karmarkar-Karp differencing.

A document's full windows stand alone; what remains is cut into pieces of at most a quarter window. Pieces of one task
are gathered into groups. In each group the pieces, largest first, form partial partitions of as many slots as there
are windows; the two partitions with the largest imbalance are merged, the fullest slot of one meeting the emptiest of
the other, until one partition is left: the windows, nearly equal. While a window exceeds the capacity, the group is
divided anew into more windows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ridertide.llm.arrays import give_back, ranges
from ridertide.llm.tables import arrow_batches
from ridertide.llm.tokens import pieces

CAPACITY, FILE, END = 1024, "byte_bpe_50k.json", 0
#: Pieces that are divided together: a group wastes less than a window by rounding up, whatever its size.
GROUP = 4096
#: Window numbers of a task start at its partition number times this.
TASK_WINDOWS = 1 << 33
#: Row of the lengths in the arrays of pieces: key, whether it is null, start, length, crc, tokens.
LENGTHS = 3

SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def differenced(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each size, sums of the windows) for a fixed number of windows."""
    order = np.argsort(-sizes, kind="stable")
    blocks = -(-len(sizes) // windows)
    padded = np.full(blocks * windows, -1)
    padded[: len(sizes)] = order
    heap = []
    for b in range(blocks):
        members = padded[b * windows : (b + 1) * windows]
        sums = np.where(members >= 0, sizes[members], 0)
        heap.append((int(sums[-1] - sums[0]), b, sums, members[:, None]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a, a_members = heapq.heappop(heap)
        _, _, b, b_members = heapq.heappop(heap)
        sums, members = a + b[::-1], np.hstack([a_members, b_members[::-1]])
        fullest = np.argsort(-sums, kind="stable")
        sums = sums[fullest]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tie, sums, members[fullest]))
    _, _, sums, members = heap[0]
    window = np.empty(len(sizes), np.int64)
    rows, columns = np.nonzero(members >= 0)
    window[members[rows, columns]] = rows
    return window, sums


def windows_for(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each size, number of windows): as few as the sum allows, more while one exceeds the capacity."""
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = differenced(sizes, count)
        if not len(sums) or sums.max() <= capacity:
            return window, count
        count += max(1, -(-count * int(sums.max() - capacity) // (4 * capacity)))


def offsets_in(window: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Start of each piece in its window: those before it, in order."""
    order = np.argsort(window, kind="stable")
    ends = np.cumsum(sizes[order])
    first = np.r_[True, np.diff(window[order]) > 0]
    before = (ends - sizes[order])[first]
    out = np.empty(len(sizes), np.int64)
    out[order] = ends - sizes[order] - before[np.cumsum(first) - 1]
    return out


def cut(ids: np.ndarray, bounds: np.ndarray, capacity: int, piece: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, crc) of the pieces of a batch: full windows, then at most `piece` ids each."""
    total = np.diff(bounds)
    full, rest = np.divmod(total, capacity)
    small = -(-rest // piece)
    count = full + small
    doc = np.repeat(np.arange(len(total)), count)
    k = ranges(np.zeros(len(total), np.int64), count)
    start = np.minimum(k, full[doc]) * capacity
    # The rest is cut evenly: its pieces differ by one id at most.
    j, n = np.maximum(k - full[doc], 0), np.maximum(small[doc], 1)
    start += j * rest[doc] // n
    end = np.where(k < full[doc], start + capacity, full[doc] * capacity + (j + 1) * rest[doc] // n)
    raw, at = memoryview(ids.astype("<u4").view(np.uint8)), (bounds[doc] + start) * 4
    crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + (end - start) * 4).tolist(), strict=True)]
    return doc, start, end - start, np.array(crc, np.int64)


def pack(batches: Iterator[pa.RecordBatch], capacity: int, piece: int, group: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    sequence = context.partitionId() * TASK_WINDOWS if context else 0
    held: list[np.ndarray] = []
    encoder = pieces(FILE)

    def divided(rows: np.ndarray, first: int) -> tuple[np.ndarray, int]:
        window, count = windows_for(rows[LENGTHS], capacity)
        return np.vstack([rows, window + first, offsets_in(window, rows[LENGTHS])]), first + count

    def table(rows: np.ndarray) -> pa.RecordBatch:
        key, nameless, *rest = rows
        return pa.RecordBatch.from_arrays([pa.array(key, mask=nameless.astype(bool)), *map(pa.array, rest)], schema=SCHEMA)

    for batch in batches:
        ids, bounds = encoder.encode(batch.column("text"), END)
        doc, start, length, crc = cut(ids, bounds, capacity, piece)
        key = batch.column("doc_id").cast(pa.int64())
        tokens = np.diff(bounds)
        nameless = np.asarray(key.is_null()).astype(np.int64)
        rows = np.vstack([key.fill_null(0).to_numpy()[doc], nameless[doc], start, length, crc, tokens[doc]])
        whole = length == capacity
        if n := int(whole.sum()):
            yield table(np.vstack([rows[:, whole], sequence + np.arange(n), np.zeros(n, np.int64)]))
            sequence += n
        held.append(rows[:, ~whole])
        if sum(x.shape[1] for x in held) >= group:
            waiting = np.hstack(held)
            stop = waiting.shape[1] // group * group
            for at in range(0, stop, group):
                placed, sequence = divided(waiting[:, at : at + group], sequence)
                yield table(placed)
            held = [waiting[:, stop:]]
    if held and (waiting := np.hstack(held)).shape[1]:
        yield table(divided(waiting, sequence)[0])
    encoder.forget()
    give_back()


def packed(docs: DataFrame, capacity: int = CAPACITY, piece: int | None = None, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with their place in a window: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Ids are those of the byte-level vocabulary, one end id (0) after each document. No shuffle: each task packs its
    own documents, so no group grows with the data. Window numbers are unique, not dense. A null text is empty and
    yields its end id; a null doc_id stays null; repeated rows are documents of their own; columns other than
    doc_id and text are ignored; an empty table yields no rows.
    """
    arrow_batches(docs.sparkSession)
    piece = piece or capacity // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack(batches, capacity, piece, group)

    kinds = ", ".join(f"`{name}` long" for name in SCHEMA.names)
    return docs.select("doc_id", "text").mapInArrow(run, kinds)
