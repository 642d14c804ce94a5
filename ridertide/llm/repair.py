"""Repair of conversation structure: the cheapest edits to system? (user assistant)+, by Hirschberg's divide and conquer.

A row of a conversation moves a machine of four states: nothing yet, after system, after user, after assistant. An edit
of a row is Keep, Rerole or Delete, after at most two Inserts; it is a step with a cost between two states. The costs to
reach each state from the left of a segment and to leave it to the right meet in the middle; of the states where their
sum is least the one whose edits so far come first in ASCII order is the crossing, and both halves are solved the same
way. Beside each cost the sweep carries the rank of its edits among the four states, so no edits are stored: edits that
lead to different states differ, and none is the beginning of another, as each has one letter of D, K, R for a row.
All segments of a batch are swept together, a row of each at a time.

Rows are dealt by range of (conversation, turn) and sorted. Conversations inside one range are solved where they lie.
One at the edge of a range may go on in the next: its rows are set apart, each piece (one range) is swept from all four
states to a 4 x 4 table, the same divide and conquer over tables finds the states at the pieces' edges, and the pieces
are solved apart. So a conversation of any length takes many tasks, each with a piece; only its text's hash, which has
no parallel form, is taken by one task that streams over the pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridertide.llm.tables import arrow_batches, stage

#: Bytes of text in a range.
RANGE_BYTES = 32 << 20
SPACES = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Kinds of rows: 2 * (initial s, u, a, other) + truncated, then rows that must go, then the end of the conversation.
MUST_GO, END = 8, 9
FAR = 1 << 40
#: What one row can take, in ASCII order; the first, I and II also end a conversation.
WORDS = sorted(["", "I", "II"] + ["I" * k + op for k in range(3) for op in "DKR"])
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def follows(state: int) -> int:
    """The state after an inserted or reroled row."""
    return ASSISTANT if state == USER else USER


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(cost, index of the ASCII-least cheapest word) by kind of row, state before and state after."""
    cost, word = np.full((10, 4, 4), FAR, np.int64), np.zeros((10, 4, 4), np.int64)

    def offer(kind: int, before: int, after: int, price: int, edits: str) -> None:
        new, old = (price, WORDS.index(edits)), (cost[kind, before, after], word[kind, before, after])
        if new < old:
            cost[kind, before, after], word[kind, before, after] = new

    for before in range(4):
        state = before
        for inserts in range(3):
            lead, price = "I" * inserts, 2 * inserts
            if state in (START, ASSISTANT):
                offer(END, before, START, price, lead)
            for kind in range(MUST_GO + 1):
                offer(kind, before, state, price + 3, lead + "D")
                if kind == MUST_GO:
                    continue
                initial, late = divmod(kind, 2)
                if (state, initial) in ((START, 0), (START, 1), (SYSTEM, 1), (USER, 2), (ASSISTANT, 1)):
                    offer(kind, before, (SYSTEM, USER, ASSISTANT)[initial], price + late, lead + "K")
                offer(kind, before, follows(state), price + 2 + late, lead + "R")
            state = follows(state)
    return cost, word


COST, WORD = tables()


def forward(kinds: np.ndarray, lo: np.ndarray, size: np.ndarray, start: np.ndarray, cost: np.ndarray, word: np.ndarray):
    """(cost, rank of the edits) to reach each state at the end of the segments from their start states."""
    order = np.argsort(-size, kind="stable")
    lo, size = lo[order], size[order]
    best, rank = np.full((len(lo), 4), FAR), np.zeros((len(lo), 4), np.int64)
    best[np.arange(len(lo)), start[order]] = 0
    active = len(lo)
    for step in range(int(size.max(initial=0))):
        active = int(np.searchsorted(-size[:active], -step))
        kind = kinds[lo[:active] + step]
        key = ((best[:active, :, None] + cost[kind]) << 6) | (rank[:active, :, None] << 4) | word[kind]
        key = key.min(1)
        best[:active] = np.minimum(key >> 6, FAR)
        edits = key & 63
        rank[:active] = (edits[:, :, None] > edits[:, None, :]).sum(2)
    back = np.argsort(order)
    return best[back], rank[back]


def backward(kinds: np.ndarray, hi: np.ndarray, size: np.ndarray, end: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The cost to leave each state at the beginning of the segments for their end states."""
    order = np.argsort(-size, kind="stable")
    hi, size = hi[order], size[order]
    best = np.full((len(hi), 4), FAR)
    best[np.arange(len(hi)), end[order]] = 0
    active = len(hi)
    for step in range(int(size.max(initial=0))):
        active = int(np.searchsorted(-size[:active], -step))
        kind = kinds[hi[:active] - 1 - step]
        best[:active] = np.minimum((cost[kind] + best[:active, None, :]).min(2), FAR)
    return best[np.argsort(order)]


def solve(kinds, lo, hi, start, end, cost: np.ndarray = COST, word: np.ndarray = WORD):
    """(index of the word, state before it) of each row of the segments lo to hi, given the states at their ends."""
    lo, hi, start, end = (np.asarray(x, np.int64) for x in (lo, hi, start, end))
    edits, states = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
    while len(lo):
        leaf = hi - lo == 1
        at = lo[leaf]
        edits[at], states[at] = word[kinds[at], start[leaf], end[leaf]], start[leaf]
        more = hi - lo > 1
        lo, hi, start, end = lo[more], hi[more], start[more], end[more]
        mid = (lo + hi) // 2
        best, rank = forward(kinds, lo, mid - lo, start, cost, word)
        total = best + backward(kinds, hi, hi - mid, end, cost)
        cross = ((total << 2) | rank).argmin(1)
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        start, end = np.concatenate([start, cross]), np.concatenate([cross, end])
    return edits, states


def lines_of(words: list[str], states: list[int], roles: list[str], texts: list[str]) -> list[str]:
    """The repaired rows as role:text."""
    out = []
    for word, state, role, text in zip(words, states, roles, texts, strict=True):
        for edit in word:
            if edit == "I":
                state = follows(state)
                out.append(ROLE[state] + ":")
            elif edit == "K":
                out.append(f"{role}:{text}")
            elif edit == "R":
                out.append(f"{ROLE[follows(state)]}:{text}")
    return out


def is_legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def damaged(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The damaged rows with what the repair needs of each; dropped rows stay, marked `gone`, so that no conversation
    is lost. Nulls read as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(space(conv).alias("conv"), F.col(conv).alias("conv_id"), "turn", space("role").alias("role"), space("text").alias("text"))
    fate = F.crc32(F.concat_ws(":", "conv", F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = rows.withColumn("fate", fate)
    rows = rows.withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).when(F.col("fate") > 0, F.col("text"))
    rows = rows.withColumn("text", text).withColumn("again", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    seen = F.rtrim("text", F.lit(SPACES))
    return rows.select(
        "conv",
        "conv_id",
        "turn",
        "role",
        "text",
        (F.col("fate") == 0).alias("gone"),
        F.coalesce(seen == "", F.lit(False)).alias("is_blank"),
        F.coalesce(~F.right(seen, F.lit(1)).isin(".", "!", "?"), F.lit(False)).alias("is_late"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
    )


def kind_of(initial: str, late: bool) -> int:
    return 2 * ("sua".find(initial) if initial else -1) + late if initial and initial in "sua" else 6 + late


def dealt(rows: DataFrame) -> DataFrame:
    """Rows by ranges of conversation and turn, sorted; rows that share both by role, the beginning of their text and
    digest. Equal rows may lie in two ranges."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    keys = ["conv", "turn", "role", F.substring("text", 1, 32), "digest", "uid"]
    return rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)


def solved_whole(found: list[list[dict]]) -> list[dict]:
    """The result of each of the conversations, given whole and in order."""
    kinds, bounds, results, kept = [], [0], [], []
    for rows in found:
        seen, last, turns = set(), None, set()
        counts = dict.fromkeys(COUNTS, 0)
        rows = [r for r in rows if not r["gone"]]
        for r in rows:
            initial = r["role"][:1]
            if r["is_blank"] or r["digest"] in seen:
                counts["blank" if r["is_blank"] else "duplicate"] += 1
                kinds.append(MUST_GO)
            else:
                counts["truncated"] += r["is_late"]
                kinds.append(kind_of(initial, r["is_late"]))
            seen.add(r["digest"])
            counts["illegal"] += last is not None and not is_legal(last, initial)
            last = initial
            if r["turn"] is not None:
                turns.add(r["turn"])
        counts["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        kinds.append(END)
        bounds.append(len(kinds))
        results.append(counts)
        kept.append(rows)
    kinds, bounds = np.array(kinds, np.int64), np.array(bounds)
    zero = np.zeros(len(found), np.int64)
    edits, states = solve(kinds, bounds[:-1], bounds[1:], zero, zero)
    after = np.append(states[1:], START)
    after[bounds[1:] - 1] = START
    prices = COST[kinds, states, after]
    for counts, rows, a, b in zip(results, kept, bounds[:-1], bounds[1:], strict=True):
        words = [WORDS[e] for e in edits[a:b]]
        counts["cost"] = int(prices[a:b].sum())
        counts["audit"] = "".join(words)
        lines = lines_of(words, states[a:b].tolist(), [*(r["role"] for r in rows), ""], [*(r["text"] for r in rows), ""])
        counts["repaired"] = "\n".join(lines)
    return results


def first_pass(rows: DataFrame) -> DataFrame:
    """Results of conversations that lie inside one range (`open` false), and the rows of those that may not (true)."""
    fields = {f.name: f for f in rows.schema.fields}
    schema = ", ".join(["open boolean, part int, pos long"] + [f"`{n}` {f.dataType.simpleString()}" for n, f in fields.items()] + [f"{c} long" for c in COUNTS] + ["audit string, repaired string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, first, pending = TaskContext.get().partitionId(), 0, None, []
        names = list(fields)

        def batch_of(out: list[dict], is_open: bool, like: pa.Schema) -> pa.RecordBatch:
            columns = [pa.array([is_open] * len(out), pa.bool_()), pa.array([part] * len(out), pa.int32()), pa.array([r.get("pos") for r in out], pa.int64())]
            columns += [pa.array([r.get(n) for r in out], like.field(n).type) for n in names]
            columns += [pa.array([fits(r.get(c)) for r in out], pa.int64()) for c in COUNTS]
            columns += [pa.array([r.get(c) for r in out], pa.string()) for c in ("audit", "repaired")]
            return pa.RecordBatch.from_arrays(columns, ["open", "part", "pos", *names, *COUNTS, "audit", "repaired"])

        like = None
        for batch in batches:
            like, at_edge, done = batch.schema, [], []
            for r in batch.to_pylist():
                place += 1
                r["pos"] = place
                first = r["conv"] if first is None else first
                if r["conv"] == first:
                    at_edge.append(r)
                    continue
                if pending and pending[-1]["conv"] != r["conv"]:
                    done.append(pending)
                    pending = []
                pending.append(r)
            if at_edge:
                yield batch_of(at_edge, True, like)
            if done:
                results = solved_whole(done)
                yield batch_of([{"conv": c[0]["conv"], "conv_id": c[0]["conv_id"]} | r for c, r in zip(done, results, strict=True)], False, like)
        if pending:
            yield batch_of(pending, True, like)

    return rows.mapInArrow(run, schema)


def fits(n: int | None) -> int | None:
    """Null beyond a long, as gaps between turns at both ends of the longs."""
    return n if n is None or -(1 << 63) <= n < 1 << 63 else None


def summed(table: pa.Table) -> pa.Table:
    """One row for a piece: its costs and ranks between all states, the initials at its ends, its illegal neighbours."""
    table = table.sort_by("pos")
    kinds = table.column("kind").to_numpy().astype(np.int64)
    size = np.full(4, len(kinds))
    best, rank = forward(kinds, np.zeros(4, np.int64), size, np.arange(4), COST, WORD)
    initials = table.column("initial").to_pylist()
    row = {
        "conv": table.column("conv")[0].as_py(),
        "part": table.column("part")[0].as_py(),
        "best": best.ravel().tolist(),
        "rank": rank.ravel().tolist(),
        "first": initials[0],
        "last": initials[-1],
        "illegal": sum(not is_legal(a, b) for a, b in zip(initials, initials[1:], strict=False)),
    }
    return pa.Table.from_pylist([row], pa.schema([("conv", pa.string()), ("part", pa.int32()), ("best", pa.list_(pa.int64())), ("rank", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())]))


def chained(table: pa.Table) -> pa.Table:
    """The states at the ends of a conversation's pieces; the last has the closing word, the first the cost and the
    illegal neighbours of the whole."""
    table = table.sort_by("part")
    n = table.num_rows
    cost = np.array([*table.column("best").to_pylist(), COST[END].ravel().tolist()]).reshape(n + 1, 4, 4)
    rank = np.array([*table.column("rank").to_pylist(), WORD[END].ravel().tolist()]).reshape(n + 1, 4, 4)
    # At the end a state has one word; its index may need more bits than a rank has.
    edits, states = solve(np.arange(n + 1), [0], [n + 1], [START], [START], cost, rank)
    ends = [*states[1:], START]
    first, last = table.column("first").to_pylist(), table.column("last").to_pylist()
    illegal = sum(table.column("illegal").to_pylist()) + sum(not is_legal(a, b) for a, b in zip(last, first[1:], strict=False))
    total = int(sum(cost[i, states[i], ends[i]] for i in range(n + 1)))
    head = [True] + [False] * (n - 1)
    return pa.table(
        {
            "conv": table.column("conv"),
            "part": table.column("part"),
            "start": pa.array([int(s) for s in states[:n]], pa.int32()),
            "end": pa.array([int(s) for s in states[1:]], pa.int32()),
            "close": pa.array([WORDS[edits[n]] if i == n - 1 else "" for i in range(n)], pa.string()),
            "cost": pa.array([total if h else 0 for h in head], pa.int64()),
            "illegal": pa.array([illegal if h else 0 for h in head], pa.int64()),
        }
    )


def solved_piece(table: pa.Table) -> pa.Table:
    """The audit and the repaired lines of a piece, null where there are none."""
    table = table.sort_by("pos")
    n = table.num_rows
    start, end, close = (table.column(c)[0].as_py() for c in ("start", "end", "close"))
    kinds = table.column("kind").to_numpy().astype(np.int64)
    edits, states = solve(kinds, [0], [n], [start], [end])
    words = [*(WORDS[e] for e in edits), close]
    lines = lines_of(words, [*states.tolist(), end], [*table.column("role").to_pylist(), ""], [*table.column("text").to_pylist(), ""])
    row = {"conv": table.column("conv")[0].as_py(), "part": table.column("part")[0].as_py(), "audit": "".join(words), "repaired": "\n".join(lines) if lines else None}
    return pa.Table.from_pylist([row], pa.schema([("conv", pa.string()), ("part", pa.int32()), ("audit", pa.string()), ("repaired", pa.string())]))


def joined_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and the hash of each conversation from its sorted pieces, one piece in memory at a time."""

    def row(conv: str, audit: list[str], text) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv": [conv], "audit": ["".join(audit)], "repaired_sha256": [text.hexdigest()]})

    now, audit, text, some = None, [], hashlib.sha256(), False
    for batch in batches:
        for r in batch.to_pylist():
            if now is not None and r["conv"] != now:
                yield row(now, audit, text)
                audit, text, some = [], hashlib.sha256(), False
            now = r["conv"]
            audit.append(r["audit"])
            if r["repaired"] is not None:
                text.update((b"\n" if some else b"") + r["repaired"].encode())
                some = True
    if now is not None:
        yield row(now, audit, text)


def pieces_of(edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts by conversation, audit and repaired lines by piece) of the rows that the first pass set apart."""
    here = edge.where(~F.col("gone"))
    order = F.struct("part", "pos")
    firsts = here.groupBy("conv", "digest").agg(F.min(order).alias("earliest"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 2).when(initial == "a", 4).otherwise(6) + F.col("is_late").cast("int")
    marked = here.join(firsts, ["conv", "digest"]).withColumn("is_again", order > F.col("earliest"))
    marked = marked.withColumn("initial", initial).withColumn("kind", F.when(F.col("is_blank") | F.col("is_again"), MUST_GO).otherwise(kind))
    marked = stage(marked.select("conv", "part", "pos", "turn", "role", "text", "initial", "kind", "is_blank", "is_again", "is_late"))

    tables_ = marked.select("conv", "part", "pos", "kind", "initial").groupBy("conv", "part")
    tables_ = tables_.applyInArrow(summed, "conv string, part int, best array<long>, rank array<long>, first string, last string, illegal long")
    edges = stage(tables_.groupBy("conv").applyInArrow(chained, "conv string, part int, start int, end int, close string, cost long, illegal long"))
    work = marked.select("conv", "part", "pos", "kind", "role", "text").join(edges.drop("cost", "illegal"), ["conv", "part"])
    pieces = work.groupBy("conv", "part").applyInArrow(solved_piece, "conv string, part int, audit string, repaired string")

    turns = marked.where("turn is not null").select("conv", "turn").distinct().groupBy("conv")
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count("*")
    turns = turns.agg(F.expr("cast(null as bigint)").alias("none"), span.alias("gaps"))
    fresh = ~F.col("is_blank") & ~F.col("is_again")
    counts = marked.groupBy("conv").agg(F.count_if("is_blank").alias("blank"), F.count_if(~F.col("is_blank") & F.col("is_again")).alias("duplicate"), F.count_if(fresh & F.col("is_late")).alias("truncated"))
    costs = edges.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    facts = edge.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    for more in (turns.select("conv", F.expr("try_cast(gaps as bigint)").alias("gaps"), F.lit(True).alias("some")), counts, costs):
        facts = facts.join(more, "conv", "left")
    gaps = F.when(F.col("some"), F.col("gaps")).otherwise(0).alias("gaps")
    return facts.select("conv", "conv_id", gaps, *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS[1:]]), pieces


def repaired(conversations: DataFrame, conv: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(conversations inside a range, with counts, cost, audit and the whole repaired text; facts of the others with
    the audit and text of their pieces): see `report` for all of them in one form."""
    arrow_batches(conversations.sparkSession)
    passed = stage(first_pass(dealt(damaged(conversations, conv))))
    whole = passed.where(~F.col("open")).select("conv_id", *COUNTS, "audit", "repaired")
    return whole, passed.where("open")


def report(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    A null conv_id is a conversation of its own; null roles and texts are one space, a null turn comes first and makes
    no gap. Rows that share a turn come by role, the first 32 characters and the digest of their text, so repeated rows
    lie together and all but the first are duplicates. A conversation of which no row is left has zeros, an empty audit
    and the hash of nothing. Gaps beyond a long are null. An empty table gives an empty result; only the four columns
    are read, so others may have any name."""
    whole, edge = repaired(conversations.select(conv, "turn", "role", "text"), conv)
    whole = whole.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")
    facts, pieces = pieces_of(edge)
    pieces = pieces.repartition("conv").sortWithinPartitions("conv", "part")
    texts = pieces.mapInArrow(joined_pieces, "conv string, audit string, repaired_sha256 string")
    nothing = F.lit(hashlib.sha256().hexdigest())
    facts = facts.join(texts, "conv", "left").withColumns({"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", nothing)})
    return whole.unionByName(facts.select(whole.columns))
