import inspect
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from ridertide.llm import lines, mixing, packing, registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, odd, labels, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    odd.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_near_dedup(rows):
    """One row of each class by comparing all texts: the smallest doc_id, null first."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (plain_words(r["text"]) for r in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            alike = sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if alike or (rows[i]["text"] or "") == (rows[j]["text"] or ""):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for g, r in zip(group, rows, strict=True):
        key = -(2**63) if r["doc_id"] is None else r["doc_id"]
        if g not in first or key < first[g][0]:
            first[g] = (key, r)
    return [r for _, r in first.values()]


def plain_lines(rows):
    """Rows without the lines that too many pages of their source have."""
    pages, having = Counter(r["source"] or "" for r in rows), Counter()
    for r in rows:
        having.update({(r["source"] or "", line.strip(" ")) for line in (r["text"] or "").split("\n") if line.strip(" ")})
    boiler = {k for k, n in having.items() if n >= lines.LEAST and n > lines.RATIO * pages[k[0]]}
    out = []
    for r in rows:
        if r["text"] is None:
            out.append((r["doc_id"], None))
            continue
        kept = [x for x in r["text"].split("\n") if (r["source"] or "", x.strip(" ")) not in boiler]
        text = "\n".join(kept)
        if len(kept) == len(r["text"].split("\n")) or text.strip(" "):
            out.append((r["doc_id"], text))
    return out


def plain_packed(rows):
    """(doc_id, ids of the document with its end) of each row."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.FILE))
    return [(r["doc_id"], len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in rows]


def test_stages_against_brute_force(spark, folder):
    """Each stage on what the one before it kept, against plain Python over the same rows."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, step in corpus_pipeline.STAGES:
        after = corpus_pipeline.stage(step(spark, before, folder))
        if name != "pack":
            assert after.columns == docs.columns
        rows, old = after.collect(), before.collect()
        if name == "language":
            assert sorted(str(r) for r in rows) == sorted(str(r) for r in old if any(c.isalpha() for c in r["text"] or ""))
        if name == "lines":
            assert sorted(map(str, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(str, plain_lines(old)))
        if name == "near_dedup":
            # Rows that repeat each other are the same, whichever stays.
            assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(str((r["doc_id"], r["text"])) for r in plain_near_dedup(old))
        if name == "mix":
            copies = mixing.mixed(before, spark.read.parquet(f"{folder}/labels.parquet")).collect()
            assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in copies for _ in range(r["copies"]))
            assert {str(r) for r in rows} <= {str(r) for r in old}
        if name == "pack":
            got = Counter()
            for r in rows:
                got[r["doc_id"], r["doc_tokens"]] += r["length"]
            want = Counter()
            for doc, n in plain_packed(old):
                want[doc, n] += n
            assert got == want
        before = after


def test_near_dedup_keeps_rows_that_share_a_doc_id(spark):
    rng = random.Random(1)
    b, o = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(60)) for k in "bo")
    rows = [(None, b, "en"), (None, b, "en"), (5, b, "en"), (2, o, "en"), (2, b + " x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(None, b), (2, o)], key=str)


def test_run_is_its_stages(spark, folder):
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert whole.count() > 0


def test_every_query_is_registered(spark):
    queries = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in queries) == 1
    assert queries["pipeline"] is corpus_pipeline.run
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert list(inspect.signature(corpus_pipeline.run).parameters) == ["spark", "sf_dir"]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = connection.sql(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    assert sorted(got) == sorted(want)
    columns = sorted(want)
    text = lambda frame: sorted(map(tuple, frame[columns].astype(str).to_numpy().tolist()))
    assert text(got) == text(want)
