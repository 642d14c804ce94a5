import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridertide.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, part int, audit string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) of rows (initial, must go, truncated), by trying all edits."""

    @lru_cache(None)
    def best(i: int, state: str, inserts: int) -> tuple[int, str]:
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        grown = "a" if state == "u" else "u"

        def add(price: int, letter: str, rest: tuple[int, str]) -> None:
            found.append((price + rest[0], letter + rest[1]))

        if inserts < 3:
            add(2, "I", best(i, grown, inserts + 1))
        if i < len(rows):
            initial, must_go, late = rows[i]
            add(3, "D", best(i + 1, state, 0))
            if not must_go:
                if (state, initial) in NEXT:
                    add(late, "K", best(i + 1, NEXT[state, initial], 0))
                add(2 + late, "R", best(i + 1, grown, 0))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


def brute(rows: list[tuple]) -> dict:
    """The contract's columns by conversation, in plain Python."""
    convs: dict = {}
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out = convs.setdefault(conv, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(turn, role, text)] * (2 if fate == 3 else 1)
    result = {}
    for conv, found in convs.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:32].encode(), digest(r)))
        seen, faults, marked = set(), [0, 0, 0], []
        for _, role, text in found:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else None
            if fault is not None:
                faults[fault] += 1
            seen.add((role, text))
            marked.append((role[:1], fault in (0, 1), fault == 2))
        cost, audit = cheapest(marked)
        lines, state, at = [], "", 0
        for e in audit:
            grown = "a" if state == "u" else "u"
            if e == "I":
                state = grown
                lines.append({"u": "user:", "a": "assistant:"}[state])
                continue
            _, role, text = found[at]
            at += 1
            if e == "K":
                state = role[:1]
                lines.append(f"{role}:{text}")
            elif e == "R":
                state = grown
                lines.append({"u": "user", "a": "assistant"}[state] + ":" + text)
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [m[0] for m in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result[conv] = (gaps, *faults, illegal, cost, audit, digest)
    return result


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def compare(spark, rows: list[tuple]) -> None:
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = repair.report(df).collect()
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r["conv_id"]], r["conv_id"]


def random_rows(seed: int, convs: int, most: int) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "sage"]
    texts = ["Yes.", "no", "What?", " ", None, "", "Go!\n", "ok. ", "a\tb", "é.", "日本"]
    rows = []
    for c in range(convs):
        n = rng.randint(1, most)
        turns = [rng.choice([None, t, t, t, t + 1]) for t in range(n)]
        rows += [(c, t, rng.choice(roles[: rng.choice([3, 10])]), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randint(0, 99)}.") for t in turns]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_cheapest_edits_against_all_edits(seed):
    rng = random.Random(seed)
    kinds, bounds, want = [], [0], []
    for _ in range(120):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 12))]
        kinds += [repair.MUST_GO if go else repair.kind_of(i, late) for i, go, late in rows] + [repair.END]
        bounds.append(len(kinds))
        want.append(cheapest([(i, go, late and not go) for i, go, late in rows]))
    kinds, zero = np.array(kinds), np.zeros(120, int)
    edits, states = repair.solve(kinds, bounds[:-1], bounds[1:], zero, zero)
    after = np.append(states[1:], 0)
    after[np.array(bounds[1:]) - 1] = 0
    price = repair.COST[kinds, states, after]
    for (a, b), expected in zip(zip(bounds, bounds[1:], strict=False), want, strict=True):
        assert (price[a:b].sum(), "".join(repair.WORDS[e] for e in edits[a:b])) == expected


def test_report_against_brute_force(spark):
    compare(spark, [*random_rows(1, 120, 9), (None, 1, "user", "a."), (None, None, None, None), (None, 3, "assistant", "b")])


def test_long_conversations_lie_in_many_ranges(spark):
    """One conversation holds most rows, another one many copies of a row."""
    rng = random.Random(8)
    rows = random_rows(2, 12, 6)
    rows += [(77, t, rng.choice(["user", "assistant", "user", "system"]), f"t{rng.randint(0, 60)}" + rng.choice(["", "."])) for t in range(160)]
    rows += [(78, 5, "user", "same.")] * 60 + [(78, 6, "assistant", "end.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        edge = repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))[1]
        assert edge.where("conv_id = 77").select("part").distinct().count() > 3
        assert edge.where("conv_id = 78").select("part").distinct().count() > 1
        compare(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_whole_and_dropped_conversations(spark):
    """A well-formed conversation is kept as it is; one whose rows all go has zeros."""
    gone = next(c for c in range(1, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    fine = next(c for c in range(1, 9999) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in range(3)))
    rows = [(gone, 0, "user", "Hi."), (fine, 0, "system", "Be."), (fine, 1, "user", "Hi?"), (fine, 2, "assistant", "Yes!")]
    compare(spark, rows)
    got = {r["conv_id"]: r for r in repair.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[fine]["audit"] == "KKK" and got[fine]["cost"] == 0
    assert got[gone]["audit"] == "" and got[gone]["repaired_sha256"] == hashlib.sha256().hexdigest()


def test_odd_tables(spark):
    assert repair.report(spark.createDataFrame([], SCHEMA)).count() == 0
    far = 9223372036854775807
    rows = [(3, -far, "user", "a."), (3, far, "assistant", "b.")]
    (row,) = repair.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert row["gaps"] is None or row["gaps"] == 0
    long = [(5, 0, "user", "word " * 200_000 + "."), (5, 1, "assistant", "x" * 1_000_000)]
    compare(spark, long)


def test_odd_rows_of_documents(odd, spark):
    """Other columns and their types are no matter."""
    rows = odd.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").cast("int").alias("turn"), F.col("source").alias("role"), "text", "part", "kept")
    assert repair.report(rows).count() == odd.select("doc_id").distinct().count()
