from collections import Counter

import pytest

from ridertide.llm import lines


@pytest.mark.parametrize(("ratio", "least"), [(0.1, 5), (0.3, 2)])
def test_same_as_brute_force(odd, ratio, least):
    rows = odd.collect()
    host = lambda r: r["source"] or ""
    pages = Counter(host(r) for r in rows)
    on = Counter((host(r), line) for r in rows for line in {x.strip(" ") for x in (r["text"] or "").split("\n")} if line)
    drop = {k for k, n in on.items() if n >= least and n > ratio * pages[k[0]]}
    want = []
    for r in rows:
        every = [] if r["text"] is None else r["text"].split("\n")
        kept = [x for x in every if (host(r), x.strip(" ")) not in drop]
        text = None if r["text"] is None else "\n".join(kept)
        want.append((str(r["doc_id"]), str(text), len(every), len(every) - len(kept)))
    out = lines.without_boilerplate(odd, ratio=ratio, least=least)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"]
    got = [(str(r["doc_id"]), str(r["text"]), r["n_lines"], r["n_dropped"]) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert any(w[3] for w in want)


def test_names_that_clash(odd):
    clash = odd.withColumn("n_lines", odd["doc_id"]).withColumn("boiler", odd["doc_id"])
    out = lines.without_boilerplate(clash.withColumnRenamed("source", "host"), host="host")
    assert out.count() == odd.count() and out.columns.count("n_lines") == 1


def test_empty(empty):
    assert lines.without_boilerplate(empty).count() == 0


def test_columns_of_any_name_are_kept(spark):
    rows = [(i, "shared\nown %d" % i, "h", "a", "b", "c") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host_key string, boiler string, lines_kept string")
    out = lines.without_boilerplate(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert {(r["host_key"], r["boiler"], r["lines_kept"], r["n_dropped"]) for r in out.collect()} == {("a", "b", "c", 1)}
    assert {r["text"] for r in out.collect()} == {f"own {i}" for i in range(12)}
