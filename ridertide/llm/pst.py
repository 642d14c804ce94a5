"""Language-model scores by a probabilistic suffix tree over words.

A node of the tree is a context of up to DEPTH = 2 words with the words seen after it. A context is retained if its
smoothed distribution differs from that of its longest retained suffix: its count times the divergence of the two must
be THRESHOLD nats or more. A word's probability comes from the longest suffix of what precedes it that is retained:

    p(w | s) = max(c(s, w) - D, 0) / c(s) + D t(s) / c(s) * p(w | longest retained suffix of s)

with t(s) the number of different words after s; at the root stands p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), so that each
distribution sums to 1 over the known words and one unknown. Contexts start at the beginning of a text and end with it.

Tree and texts are too large to send to all tasks, so both are dealt by the last word of the context: all contexts with
that last word, and all places where a text has it, meet in one shard, which builds that part of the tree and scores
those places. Places travel in compact blocks, not as rows. The counts of the words come from a first exchange by word,
where each shard asks for the words that it will meet. A word so frequent that it fills shards alone has several,
dealt by the word before it; what all of them must know, the counts of its followers, comes from an exchange of the
same kind, and the test of the word as a context is a sum over its shards, each follower in one of them. Scores of places are summed by text in each shard, and by text
over the shards. Blocks go in waves, each for a part of the shards, to halve the disk they need at once. A shard is as
large as a task can hold compressed, so that a block's list of words is small beside its places and a text has few sums;
its places lie in drawers, by context again, and only one drawer is opened at a time. Places and answers of a shard come
in one stream, and a batch is let go once it is read, so that a task never holds two shards.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridertide.llm.arrays import flat, give_back, mixed, span_hashes, words
from ridertide.llm.tables import arrow_batches, release, stage, text_bytes

DISCOUNT = 0.75
#: About as many bytes of text as a token has.
TOKEN_BYTES = 8
#: Places of a shard that are worked on at once, and bytes of text.
PORTION, SLICE = 250_000, 1 << 20
#: What stands for the end of a text, its beginning, and what is before that.
STOP, BEGIN, NONE = np.uint64(1), np.uint64(2), np.uint64(3)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Columns of places by drawer, and of what a shard sends back.
SPLIT = ("word", "last", "before", "slot")
SUMS = ("block", "slots", "docs", "learn", "score", "base", "known", "size")


@dataclass
class Settings:
    """threshold: nats that a context must be worth. shard_bytes: text of a shard. drawers: parts of a shard. block_tokens:
    tokens of a block. hot: times a word occurs until it gets shards of its own, of so many tokens or as many as other
    shards have. waves: the blocks go in so many parts."""

    threshold: float = 0.5
    shard_bytes: int = 64 << 20
    drawers: int = 8
    block_tokens: int = 2_200_000
    hot: int = 1_500_000
    waves: int = 2


@dataclass
class Layout:
    """Shards by the last word of a context; hot words have `parts` shards of their own from `first` on."""

    shards: int
    settings: Settings
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted
    count: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def first(self) -> np.ndarray:
        return self.shards + np.cumsum(self.parts) - self.parts

    @property
    def all(self) -> int:
        return self.shards + int(self.parts.sum())

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index among the hot words, whether it is one) of each key."""
        if not len(self.hot):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)
        return at, self.hot[at] == keys

    def plain(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys ^ ODD) % np.uint64(self.shards)).astype(np.int64)

    def of(self, every: np.ndarray, last: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The shard of each place, whose words are numbers in `every`. At the beginning of a text nothing is before, so
        the word itself deals."""
        out = self.plain(every).astype(np.int32)[last]
        at, is_hot = self.place(every)
        if is_hot.any():
            mine = np.flatnonzero(is_hot[last])
            at = at[last[mine]]
            dealer = np.where(every[last[mine]] == BEGIN, word[mine], before[mine])
            out[mine] = self.first[at] + (mixed(every)[dealer] % self.parts[at].astype(np.uint64)).astype(np.int64)
        return out

    def drawer(self, every: np.ndarray, last: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The drawer of each place in its shard: by what follows together, as shards are dealt."""
        drawer = (mixed(mixed(every) + ODD) % np.uint64(self.settings.drawers)).astype(np.int32)
        out = drawer[last]
        mine = np.flatnonzero(self.place(every)[1][last])
        out[mine] = drawer[np.where(every[last[mine]] == BEGIN, word[mine], before[mine])]
        return out

    def hot_of(self, shards: np.ndarray) -> np.ndarray:
        """The index of the hot word of shards that belong to one."""
        return np.searchsorted(self.first, shards, "right") - 1


def packed(values: np.ndarray) -> bytes:
    """Bytes of the numbers, all lowest bytes first, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).ravel()


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key among the distinct ones in order, index of one occurrence of each distinct key)."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    ranked = keys[order]
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    del ranked
    rank = np.cumsum(new, dtype=np.int32 if len(keys) < 1 << 31 else np.int64)
    rank -= 1
    number = np.empty_like(rank)
    number[order] = rank
    return number, order[new]


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order. The array given is sorted in place."""
    values.sort()
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def joint(a: np.ndarray, b: np.ndarray, below: int) -> np.ndarray:
    """A number for each pair of a and b, which is under `below`."""
    out = a.astype(np.int64)
    out *= below
    out += b
    return out


def followers(last: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A key for each pair of a word and its follower."""
    return mixed(mixed(last) * np.uint64(3) + word)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of words, about SLICE bytes at a time: a hash takes tens of bytes for each byte of a word."""
    out = np.empty(len(starts), np.uint64)
    edges = [0]
    while edges[-1] < len(starts):
        edges.append(max(edges[-1] + 1, int(np.searchsorted(starts, starts[edges[-1]] + SLICE))))
        a, b = edges[-2:]
        out[a:b] = span_hashes(data, starts[a:b], ends[a:b])
    return np.maximum(out, NONE + np.uint64(1))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words in lower case, each text's followed by STOP; tokens by text)."""
    data, offsets = flat(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, each = words(data, offsets)
    out = np.full(len(starts) + len(each), STOP)
    slot = np.repeat(np.arange(len(each)), each)
    out[np.arange(len(starts)) + slot] = word_hashes(data, starts, ends)
    return out, each + 1


@dataclass
class Block:
    """Texts one after another: for each token its word, the two before it and its text. Words are numbers in `every`,
    whose last two are BEGIN and NONE."""

    every: np.ndarray
    word: np.ndarray
    last: np.ndarray
    before: np.ndarray
    slot: np.ndarray
    keys: pa.Array
    learn: np.ndarray


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Block]:
    """Blocks of whole texts that end with the text that makes them `most` tokens. Columns: text, key, learn."""
    parts: list[tuple] = []
    size = 0

    def whole() -> Block:
        each, learn = np.concatenate([p[1] for p in parts]), np.concatenate([p[3] for p in parts])
        keys = pa.concat_arrays([p[2] for p in parts])
        hashes = np.concatenate([p[0] for p in parts])
        parts.clear()
        word, one = groups(hashes)
        every = np.concatenate([hashes[one], [BEGIN, NONE]])
        del hashes
        first = np.cumsum(each) - each
        last = np.empty_like(word)
        last[1:] = word[:-1]
        last[first] = len(one)
        before = np.empty_like(word)
        before[1:] = last[:-1]
        before[first] = len(one) + 1
        return Block(every, word, last, before, np.repeat(np.arange(len(each), dtype=np.int32), each), keys, learn)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        found, each = tokens(batch.column(0))
        parts.append((found, each, batch.column(1), np.asarray(batch.column(2)).astype(bool)))
        size += len(found)
        if size >= most:
            del found, each
            block = whole()
            size = 0
            give_back()
            yield block
            del block
    if parts:
        yield whole()


def questions(rows: DataFrame, layout: Layout, ask: Callable[[Block], tuple]) -> DataFrame:
    """Rows (home, keys, counts, widths, shards): for each key of a block how often it occurs in texts to learn from,
    and the shards that will want to know its total; by the home of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, layout.settings.block_tokens):
            batch = asked_by(layout, *ask(block))
            # The next block is made while this would still be held.
            del block
            give_back()
            yield from batch

    return rows.mapInArrow(run, "home int, keys binary, counts binary, widths binary, shards binary")


def asked_by(layout: Layout, keys: np.ndarray, number: np.ndarray, learn: np.ndarray, shard: np.ndarray) -> list[pa.RecordBatch]:
    """The rows of one block; none without a key. keys: the distinct ones, number: which of them each place has."""
    if not len(keys):
        return []
    counts = np.bincount(number[learn], minlength=len(keys)).astype(np.uint32)
    of, wanted = np.divmod(distinct(joint(number, shard, layout.all)), layout.all)  # by key, then by shard
    home = layout.plain(keys)
    order = np.argsort(home, kind="stable")
    bounds = np.searchsorted(home[order], np.arange(layout.shards + 1))
    width = np.bincount(of, minlength=len(keys))
    begin = np.cumsum(width) - width
    out: list[tuple] = []
    for h in np.flatnonzero(np.diff(bounds)):
        mine = order[bounds[h] : bounds[h + 1]]  # keys in order
        places = np.repeat(begin[mine] - np.cumsum(width[mine]) + width[mine], width[mine]) + np.arange(width[mine].sum())
        out.append((int(h), packed(keys[mine]), packed(counts[mine]), packed(width[mine].astype(np.uint32)), packed(wanted[places].astype(np.uint32))))
    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)]
    return [pa.RecordBatch.from_arrays(columns, ["home", "keys", "counts", "widths", "shards"])]


ANSWER = "shard int, kind int, keys binary, counts binary, total long, distinct long"


def answers(asked: DataFrame, layout: Layout, kind: int) -> DataFrame:
    """For each home and shard the keys that the shard asked for with their totals (kind; pairs that it is the first
    shard to ask for have kind 2). Beside them, with a negative shard: -1 the sum of all counts and the number of keys counted, -2 frequent keys, -3 the different followers of
    each hot word (total: its index)."""

    def told_to(table: pa.Table) -> pa.Table:
        keys, counts, widths, shards = ([unpacked(b.as_py(), t) for b in table.column(c)] for c, t in (("keys", np.uint64), ("counts", np.uint32), ("widths", np.uint32), ("shards", np.uint32)))
        joined = np.concatenate(keys)
        number, one = groups(joined)
        every = joined[one]
        del keys, joined, one
        total = np.bincount(number, np.concatenate(counts)).astype(np.int64)
        del counts
        of, shard = np.repeat(number, np.concatenate(widths)), np.concatenate(shards)
        del number, widths, shards
        shard, of = np.divmod(distinct(joint(shard, of, len(every))), len(every))
        kinds = np.full(len(of), kind)
        if kind == 1:
            kinds[np.unique(of, return_index=True)[1]] = 2
            order = np.lexsort([kinds, shard])
            shard, of, kinds = shard[order], of[order], kinds[order]
        bounds = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (kinds[1:] != kinds[:-1]), [True]])) if len(shard) else np.zeros(1, np.int64)
        out = [(int(shard[a]), int(kinds[a]), packed(every[of[a:b]]), packed(total[of[a:b]].astype(np.uint32 if total.max() < 1 << 32 else np.uint64)), 0, 8 if total.max() >= 1 << 32 else 4) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if kind == 0:
            counted = (total > 0) & (every != BEGIN)
            out.append((-1, kind, b"", b"", int(total[counted].sum()), int(counted.sum())))
            often = (total > layout.settings.hot) & (every != STOP)  # nothing follows an end
            if often.any():
                out.append((-2, kind, packed(every[often]), packed(total[often].astype(np.uint64)), 0, 8))
        else:
            seen = total[of] > 0
            pairs = np.unique(layout.hot_of(shard[seen]) * len(every) + of[seen])
            n = np.bincount(pairs // len(every), minlength=len(layout.hot))
            out += [(-3, kind, b"", b"", int(i), int(n[i])) for i in np.flatnonzero(n)]
        names = ["shard", "kind", "keys", "counts", "total", "distinct"]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*out, strict=True), types, strict=True)})

    def run(table: pa.Table) -> pa.Table:
        out = told_to(table)
        give_back()
        return out

    return asked.groupBy("home").applyInArrow(run, ANSWER)


def counted_words(block: Block, layout: Layout) -> tuple:
    """All words, and once for each text its beginning, which no shard asks for by itself."""
    shard = layout.of(block.every, block.last, block.before, block.word)
    texts = len(block.learn)
    begin = np.full(texts, len(block.every) - 2, block.word.dtype)
    return block.every[:-1], np.concatenate([block.word, begin]), np.concatenate([block.learn[block.slot], block.learn]), np.concatenate([shard, np.zeros(texts, shard.dtype)])


def counted_followers(block: Block, layout: Layout) -> tuple:
    """The followers of hot words."""
    mine = np.flatnonzero(layout.place(block.every)[1][block.last])
    last, word = block.last[mine], block.word[mine]
    pairs = followers(block.every[last], block.every[word])
    number, one = groups(pairs)
    return pairs[one], number, block.learn[block.slot[mine]], layout.of(block.every, last, block.before[mine], word)


def dealt_places(rows: DataFrame, layout: Layout, wave: int, waves: int) -> DataFrame:
    """All places of the shards of a wave as rows (shard, block, keys, word, last, before, slot, docs, learn)."""
    key_type = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for n, block in enumerate(blocks(batches, layout.settings.block_tokens)):
            every = block.every
            shard = layout.of(every, block.last, block.before, block.word)
            drawers = layout.settings.drawers
            home = shard * drawers + layout.drawer(every, block.last, block.before, block.word)
            mine = np.flatnonzero(shard % waves == wave)
            mine = mine[np.argsort(home[mine], kind="stable")]
            first_of = np.searchsorted(shard[mine], np.arange(layout.all + 1))
            for s in np.flatnonzero(np.diff(first_of)):
                at = mine[first_of[s] : first_of[s + 1]]
                ids = np.concatenate([block.word[at], block.last[at], block.before[at]])
                used = np.zeros(len(every), bool)
                used[ids] = True
                new = (np.cumsum(used) - 1).astype(np.uint32)
                slots, slot = np.unique(block.slot[at], return_inverse=True)
                edges = np.searchsorted(home[at], s * drawers + np.arange(drawers + 1))
                parts = [[packed(x[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)] for x in (*new[ids].reshape(3, -1), slot.astype(np.uint32))]
                columns = [pa.array([int(s)], pa.int32()), pa.array([part + n], pa.int64()), pa.array([packed(every[used])], pa.binary())]
                columns += [pa.array([p], pa.list_(pa.binary())) for p in parts]
                columns.append(pa.array([packed(slots.astype(np.uint32))], pa.binary()))
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(slots)], pa.int32()), block.keys.take(pa.array(slots))))
                columns.append(pa.array([block.learn[slots].astype(np.uint8).tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "keys", "word", "last", "before", "slot", "slots", "docs", "learn"])
            # The next block is made while these would still be held.
            del block, every, shard, home, mine
            give_back()

    lists = ", ".join(f"{c} array<binary>" for c in SPLIT)
    schema = f"shard int, block long, keys binary, {lists}, slots binary, docs array<{key_type}>, learn binary"
    return rows.mapInArrow(run, schema)


def told(known: list[dict], *kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) that the answers of these kinds hold, by key."""
    rows = [r for r in known if r["kind"] in kinds]
    keys = np.concatenate([np.empty(0, np.uint64), *(unpacked(r["keys"], np.uint64) for r in rows)])
    order = np.argsort(keys)
    keys = keys[order]
    counts = np.concatenate([np.empty(0, np.int64), *(unpacked(r["counts"], np.uint32 if r["distinct"] == 4 else np.uint64).astype(np.int64) for r in rows)])
    return keys, counts[order]


def looked_up(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of keys in a sorted list, 0 where they aren't in it."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], 0)


def at_root(count: np.ndarray, n: int, v: int) -> np.ndarray:
    """The probability at the root of words with these counts, of n tokens and v words."""
    return (count + 0.1) / (n + 0.1 * (v + 1))


def apart_from_root(layout: Layout, different: np.ndarray, n: int, v: int, known: pa.Table) -> pa.Table:
    """(index of the hot word, sum of p, sum of p log(p / root)) over the followers that one of its shards is the first
    to have."""
    hot = int(layout.hot_of(np.array([known.column("shard")[0].as_py()]))[0])
    rows = known.to_pylist()
    words_, counts = told(rows, 0)
    count = looked_up(followers(layout.hot[hot : hot + 1], words_), *told(rows, 2))
    seen = count > 0
    over = at_root(counts[seen], n, v)
    p = np.maximum(count[seen] - DISCOUNT, 0) / layout.count[hot] + DISCOUNT * different[hot] / layout.count[hot] * over
    return pa.table({"hot": pa.array([hot], pa.int32()), "mass": [float(p.sum())], "apart": [float((p * np.log(p / over)).sum())]})


def level(context: np.ndarray, word: np.ndarray, learn: np.ndarray, parent: np.ndarray, words_: int, threshold: float, whole: tuple | None = None):
    """(probability, whether its context is retained) of each place, given the parents' probabilities. whole: (count of
    the context, different followers, is it retained, count of each place's pair) where other shards have places of the
    context."""
    number, one = groups(joint(context, word, words_))
    of, over = context[one], parent[one]
    if whole is None:
        count = np.bincount(number[learn > 0], minlength=len(one))
        n = np.bincount(of, count)
        t = np.bincount(of, count > 0, minlength=len(n))
    else:
        count = whole[3][one].astype(float)
        n, t = np.full(int(of.max(initial=0)) + 1, float(whole[0])), np.full(int(of.max(initial=0)) + 1, float(whole[1]))
    some = n > 0
    rest = np.divide(DISCOUNT * t, n, out=np.ones(len(n)), where=some)
    p = np.divide(np.maximum(count - DISCOUNT, 0), n[of], out=np.zeros(len(one)), where=some[of]) + rest[of] * over
    if whole is not None:
        retained = some & whole[2]
    else:
        seen = count > 0
        mass = np.bincount(of, np.where(seen, p, 0.0), minlength=len(n))
        apart = np.bincount(of, np.where(seen, p * np.log(p / over), 0.0), minlength=len(n)) + (1 - mass) * np.log(rest)
        retained = some & (n * apart >= threshold)
    return p[number], retained[context]


def probabilities(word, last, before, learn, root: np.ndarray, words_: int, nothing: int, threshold: float, whole: tuple | None = None) -> np.ndarray:
    """The tree's probability of each place of a shard; numbers of words are below words_, `nothing` stands for NONE."""
    out = root.copy()
    p, retained = level(groups(last)[0], word, learn, root, words_, threshold, whole)
    out[retained] = p[retained]
    del p, retained
    every = np.flatnonzero(before != nothing)
    # A word that fills more than a portion has many contexts, which don't meet either.
    for part in portions(joint(last[every], before[every], words_)):
        deep = every[part]
        context, _ = groups(joint(last[deep], before[deep], words_))
        learned = np.bincount(context[learn[deep] > 0], minlength=int(context.max()) + 1)[context] > 0
        deep, context = deep[learned], context[learned]
        if len(deep):
            p, retained = level(context, word[deep], learn[deep], out[deep], words_, threshold)
            out[deep[retained]] = p[retained]
    return out


def portions(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of about PORTION places at a time; places with the same key are together."""
    order = np.argsort(keys, kind="stable")
    ranked, start = keys[order], 0
    while start < len(keys):
        stop = min(start + PORTION, len(keys))
        stop = int(np.searchsorted(ranked, ranked[stop - 1], "right"))
        yield order[start:stop]
        start = stop


def received(batches: Iterator[pa.RecordBatch]) -> tuple[list[dict], list[dict]]:
    """(rows of places, answers) of a shard, which come mixed; nothing else of the batches is held."""
    places, known = [], []
    for batch in batches:
        for i, row in enumerate(batch.drop_columns(["docs"]).to_pylist()):
            if row["block"] is None:
                known.append(row)
            else:
                places.append(row | {"docs": batch.column("docs").take(pa.array([i]))})
    return places, known


def scored_shard(layout: Layout, different: np.ndarray, retained: np.ndarray, n: int, v: int, places: list[dict], known: list[dict]) -> list[dict]:
    """Sums by text of a shard's places, a row for each block. What is read is taken out of the rows."""
    shard = places[0]["shard"]
    hot = int(layout.hot_of(np.array([shard]))[0]) if shard >= layout.shards else None
    dictionaries = [unpacked(r.pop("keys"), np.uint64) for r in places]
    at = np.cumsum([0, *map(len, dictionaries)])
    every = distinct(np.concatenate([np.array([NONE]), *dictionaries]))
    number, nothing = np.empty(int(at[-1]), np.int32), int(np.searchsorted(every, NONE))
    for i, a in enumerate(at[:-1]):
        number[a : at[i + 1]] = np.searchsorted(every, dictionaries[i])
    del dictionaries
    count = looked_up(every, *told(known, 0))
    pairs = None if hot is None else told(known, 1, 2)
    known.clear()
    root_of = at_root(count, n, v)
    slots = [unpacked(r["slots"], np.uint32) for r in places]
    base_of = np.cumsum([0, *map(len, slots)])
    learned = np.concatenate([np.frombuffer(r["learn"], np.uint8) for r in places]) > 0
    texts = int(base_of[-1])
    score, base, found, size = np.zeros(texts), np.zeros(texts), np.zeros(texts, np.int64), np.zeros(texts, np.int64)

    def drawer(c: str, d: int, made: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
        out = []
        for i, r in enumerate(places):
            out.append(made(i, unpacked(r[c][d], np.uint32)))
            r[c][d] = None
        return np.concatenate(out)

    for d in range(layout.settings.drawers):
        word, last, before = (drawer(c, d, lambda i, ids: number[at[i] :][ids]) for c in SPLIT[:3])
        text = drawer("slot", d, lambda i, slot: slot.astype(np.int64) + base_of[i])
        give_back()
        # Contexts of different words don't meet: a part of the places at a time.
        for part in portions(last if hot is None else before):
            w, here = word[part], text[part]
            whole = None
            if hot is not None:
                whole = (layout.count[hot], different[hot], retained[hot], looked_up(followers(every[last[part]], every[w]), *pairs))
            p = probabilities(w, last[part], before[part], learned[here], root_of[w], len(every), nothing, layout.settings.threshold, whole)
            score += np.bincount(here, np.log10(p), minlength=texts)
            del p, whole
            base += np.bincount(here, np.log10(root_of[w]), minlength=texts)
            found += np.bincount(here[count[w] > 0], minlength=texts)
            size += np.bincount(here, minlength=texts)
    out = []
    for i, (a, b) in enumerate(zip(base_of[:-1], base_of[1:], strict=True)):
        row = {c: places[i][c] for c in ("block", "slots", "docs", "learn")}
        out.append(row | {"score": packed(score[a:b]), "base": packed(base[a:b]), "known": packed(found[a:b].astype(np.uint32)), "size": packed(size[a:b].astype(np.uint32))})
    return out


PARTS = ["slots", "score", "base", "known", "size"]


def summed_block(table: pa.Table, names: list[str], key: pa.DataType) -> pa.Table:
    """The texts of a block with the sums over all shards."""
    column = lambda c, t: np.concatenate([unpacked(x.as_py(), t) for x in table.column(c)])
    slot, one = groups(column("slots", np.uint32))
    docs = pa.concat_arrays([d.values for d in table.column("docs")]).take(pa.array(one))
    learn = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("learn")])[one]
    total = lambda c, t: np.bincount(slot, column(c, t))
    columns = [docs.cast(key), pa.array(learn == 0), pa.array(total("size", np.uint32).astype(np.int64)), pa.array(total("known", np.uint32).astype(np.int64))]
    return pa.Table.from_arrays([*columns, pa.array(total("base", np.float64)), pa.array(total("score", np.float64))], names)


def held_out(key: str = "doc_id"):
    """A tenth of the documents, by the CRC of their number as text; a null number is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 10 == 0, F.lit(False))


def scored(docs: DataFrame, key: str = "doc_id", settings: Settings | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs, by a tree learned from
    the rows that aren't held out.

    A null text is empty: its end is its one token. Rows that share a number are scored each by its own text, repeated
    rows are learned from each time. Only `key` and `text` are read, so other columns may have any name. An empty table
    gives an empty result. Without a text to learn from nothing is known and every token has probability 1."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select("text", F.col(key).alias("key"), (~held_out(key)).alias("learn"))
    settings = settings or Settings()
    layout = plain = Layout(max(1, -(-text_bytes(docs) // settings.shard_bytes)), settings)

    replies = stage(answers(questions(rows, layout, lambda b: counted_words(b, plain)), layout, 0))
    totals = replies.where("shard = -1").agg(F.sum("total"), F.sum("distinct")).first()
    n, v = totals[0] or 0, totals[1] or 0
    often = replies.where("shard = -2").select("keys", "counts").collect()
    different, retained = np.empty(0, np.int64), np.empty(0, bool)
    replies = replies.where("shard >= 0")
    if often:
        hot = np.concatenate([unpacked(r["keys"], np.uint64) for r in often])
        count = np.concatenate([unpacked(r["counts"], np.uint64) for r in often]).astype(np.int64)
        order = np.argsort(hot)
        most = max(1, settings.hot, settings.shard_bytes // TOKEN_BYTES)
        layout = Layout(plain.shards, settings, hot[order], count[order], -(-count[order] // most))
        asked = questions(rows, layout, lambda b: counted_followers(b, layout))
        pairs = stage(answers(asked, layout, 1))
        different = np.zeros(len(hot), np.int64)
        for r in pairs.where("shard = -3").groupBy("total").agg(F.sum("distinct").alias("n")).collect():
            different[r["total"]] = r["n"]
        # The shards of a hot word need the counts that the shard it would have had asked for.
        source = np.repeat(layout.plain(layout.hot), layout.parts)
        # Written first: its size then tells Spark how to join it.
        links = stage(spark.createDataFrame([(int(s), layout.shards + i) for i, s in enumerate(source)], "shard int, own int"))
        copies = replies.join(links, "shard").select(F.col("own").alias("shard"), *replies.columns[1:])

        def tested(known: pa.Table) -> pa.Table:
            return apart_from_root(layout, different, n, v, known)

        sums = copies.unionByName(pairs.where("shard >= 0 and kind = 2")).groupBy("shard").applyInArrow(tested, "hot int, mass double, apart double")
        retained = np.zeros(len(hot), bool)
        for r in sums.groupBy("hot").agg(F.sum("mass").alias("mass"), F.sum("apart").alias("apart")).collect():
            count, rest = layout.count[r["hot"]], DISCOUNT * different[r["hot"]] / layout.count[r["hot"]]
            retained[r["hot"]] = count * (r["apart"] + (1 - r["mass"]) * np.log(rest)) >= settings.threshold
        del sums
        release(spark)
        replies = replies.unionByName(copies).unionByName(pairs.where("shard >= 0"))

    key_type = rows.schema["key"].dataType.simpleString()
    schema = f"block long, slots binary, docs array<{key_type}>, learn binary, score binary, base binary, known binary, size binary"
    waves = max(1, min(settings.waves, layout.all))
    found = []
    for wave in range(waves):
        wanted = replies.where(F.col("shard") % waves == wave)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places, known = received(batches)
            if not places:
                return
            out = scored_shard(layout, different, retained, n, v, places, known)
            docs = pa.concat_arrays([r.pop("docs") for r in out])
            columns = {"block": pa.array([r["block"] for r in out], pa.int64())} | {c: pa.array([r[c] for r in out], pa.binary()) for c in out[0] if c != "block"} | {"docs": docs}
            del places, known, out, docs
            give_back()
            yield pa.RecordBatch.from_arrays([columns[c] for c in SUMS], list(SUMS))

        # Two streams would be read whole, and the next shard before the last one is let go.
        both = dealt_places(rows, layout, wave, waves).unionByName(wanted.drop("total"), allowMissingColumns=True)
        found.append(stage(both.groupBy("shard").applyInArrow(run, schema)))
        release(spark)
    parts = found[0]
    for more in found[1:]:
        parts = parts.unionByName(more)
    names = [key, "held_out", "n_tokens", "n_known", "base_score", "score"]

    def summed(table: pa.Table) -> pa.Table:
        out = summed_block(table, names, table.schema.field("docs").type.value_type)
        give_back()
        return out

    out = parts.groupBy("block").applyInArrow(summed, f"`{key}` {key_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n).cast("long")).select(key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
