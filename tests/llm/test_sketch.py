import hashlib
import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from ridertide.llm import sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, length=5):
    words = WORD.findall(text)
    parts = [words[i : i + length] for i in range(len(words) - length + 1)] or ([words] if words else [])
    return {hashlib.md5(" ".join(p).encode()).hexdigest()[:16] for p in parts}


def retained(text, limit="1" + "0" * 15):
    every = sorted(shingles(text))
    below = [h for h in every if h < limit]
    return below if len(below) >= 16 else every[:16]


def bound(s, limit="1" + "0" * 15):
    return "~" if len(s) < 16 else max(limit, s[-1] + "~")


def alike(a, b):
    top = min(bound(a), bound(b))
    x, y = {h for h in a if h < top}, {h for h in b if h < top}
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("part_bytes", [sketch.PART_BYTES, 2000])
def test_same_as_brute_force(odd, part_bytes):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r))
    want = []
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        s, e, n = retained(text), retained(edited), retained(after)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        want.append((str(doc_id), len(text), digest, "".join(s), "".join(e), alike(s, e), alike(s, n)))
    got = sketch.fingerprints(odd, part_bytes=part_bytes).collect()
    got = [(str(r["doc_id"]), *r[1:7]) for r in got]
    assert sorted(got) == sorted(want)


def test_part_of_counts_the_cuts_below(spark):
    cuts = [-5, 0, 3, 9, 10, 44, 100]
    keys = spark.range(-10, 120).select(F.col("id").alias("key"))
    for n in range(len(cuts) + 1):
        rows = keys.withColumn("part", sketch.part_of(F.col("key"), cuts[:n])).collect()
        assert all(r["part"] == sum(c < r["key"] for c in cuts[:n]) for r in rows)


def test_sketches_merge_and_estimate_containment(spark):
    words = [f"w{i}" for i in range(6000)]
    whole, part = " ".join(words), " ".join(words[1000:2500])
    other = " ".join(f"v{i}" for i in range(3000))
    of = lambda c: sketch.retained(sketch.shingle_hashes(sketch.words(F.col(c))))
    row = spark.createDataFrame([(whole, part, other, whole + " " + other)], ["a", "b", "c", "d"])
    row = row.select(*[of(c).alias(c) for c in "abcd"]).select(
        sketch.containment(F.col("b"), F.col("a")).alias("inside"),
        sketch.containment(F.col("a"), F.col("b")).alias("share"),
        sketch.containment(F.col("c"), F.col("a")).alias("apart"),
        sketch.resemblance(F.col("d"), sketch.merged(F.array("a", "c"))).alias("merged"),
    )
    found = row.first()
    assert found["inside"] == 1 and found["apart"] == 0
    assert abs(found["share"] - 0.25) < 0.1
    assert found["merged"] > 0.98


def test_links_between_parts_order_numbers_only(spark):
    rows = [(p, 10 * p + k, f"text {p} {k}") for p in (0, 2, 3, 7) for k in (2, 1)]
    links = sketch.links_of(spark.createDataFrame(rows, "part int, key long, text string"))
    assert {r["part"]: r["link"] for r in links.collect()} == {0: "text 2 1", 2: "text 3 1", 3: "text 7 1", 7: "text 0 1"}
    windows = [x for x in links._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert windows and not any("text" in x for x in windows)


NEW_SESSION = """
import sys
from ridertide.llm import sketch
from ridertide.session import local_session

spark = local_session(2, partitions=4, app="new")
docs = spark.read.parquet(sys.argv[1])
plan = sketch.fingerprints(docs, part_bytes=2000)
plan.write.parquet(sys.argv[2])
spark.stop()
"""


def test_first_query_of_a_session_has_parts(spark, tmp_path):
    # There columns have numbers as small as those that Spark gives lambda variables.
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(40)), "en", "web", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/docs")
    env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p), "PYTHONDONTWRITEBYTECODE": "1"}
    args = [sys.executable, "-c", NEW_SESSION, f"{tmp_path}/docs", f"{tmp_path}/out"]
    run = subprocess.run(args, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    want = sketch.fingerprints(docs).collect()
    assert len(want) == 200 and sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(want)


def outer_lambdas(expression):
    if expression.getClass().getSimpleName() == "LambdaFunction":
        return [expression]
    below = expression.children()
    return [x for i in range(below.size()) for x in outer_lambdas(below.apply(i))]


def test_lambdas_refer_to_no_column_outside(spark):
    df = spark.range(1).select("id", F.array(F.lit("a")).alias("a"), F.array(F.lit("b")).alias("b"))
    columns = [
        sketch.part_of(F.col("id"), [0, 3, 9]),
        sketch.retained(F.col("a")),
        sketch.shingle_hashes(F.col("a")),
        sketch.resemblance(F.col("a"), F.col("b")),
        sketch.containment(F.col("a"), F.col("b")),
        sketch.merged(F.array("a", "b")),
    ]
    for column in columns:
        shown = df.select(column.alias("c"))._jdf.queryExecution().analyzed().expressions()
        lambdas = [x for i in range(shown.size()) for x in outer_lambdas(shown.apply(i))]
        assert lambdas and all(x.references().isEmpty() for x in lambdas)


def test_empty(empty):
    assert sketch.fingerprints(empty).count() == 0
