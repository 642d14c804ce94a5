import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ridertide.llm import langid

ENGLISH = "the cat and the dog with a ball that was in this house by the sea"
GERMAN = "der Hund und die Katze mit einem Ball der nicht in diesem Haus für sich war"


def test_letters_of_texts():
    chars, offsets = langid.letters(pa.array(["Aé! b", "", None, "..", "x"]))
    got = [chars[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [[0, 97, 233, 0, 98, 0], [0], [0], [0], [0, 120, 0]]


def test_grams_stay_in_their_text():
    texts = ["ab c", "", "q", "Straße zu", "日本"]
    chars, offsets = langid.letters(pa.array(texts))
    for order in langid.ORDERS:
        whole, each = langid.grams(chars, offsets, order, 1 << 30)
        alone = []
        for t in texts:
            c, o = langid.letters(pa.array([t]))
            g, n = langid.grams(c, o, order, 1 << 30)
            assert n[0] == len(g)
            alone.append(g.tolist())
        assert whole.tolist() == sum(alone, []) and each.tolist() == list(map(len, alone))


def corpus(spark):
    rows = []
    for i in range(60):
        words = (ENGLISH if i % 2 else GERMAN).split()
        rows.append((i, " ".join(words[(i * 7 + k * 3) % len(words)] for k in range(12)), "en" if i % 2 else "de"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_documents_are_recognized(spark):
    rows = langid.identified(corpus(spark)).withColumn("held", langid.held_out()).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held"]]
    assert len(held) > 5 and all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in held)


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs = corpus(spark)
    lied = docs.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))).withColumn("score", F.lit("s"))
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identified(docs).collect()}
    two = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identified(lied).collect()}
    assert one == two


def test_odd_rows(odd, empty):
    out = langid.identified(odd)
    assert out.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        some = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == langid.UNKNOWN) == (not some)
        assert (r["score"] > 0) == some and r["score"] <= 1
    assert langid.identified(empty).count() == 0
    nameless = langid.identified(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nameless} == {(langid.UNKNOWN, 0.0)}


def test_model_matches_counts(spark):
    docs = corpus(spark)
    model = langid.fit(docs)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    assert model.languages == sorted(texts)
    for k, name in enumerate(model.languages):
        chars, offsets = langid.letters(pa.array(texts[name]))
        seen = sum(langid.grams(chars, offsets, n, langid.BUCKETS)[1].sum() for n in langid.ORDERS)
        counts = {}
        for n in langid.ORDERS:
            for g in langid.grams(chars, offsets, n, langid.BUCKETS)[0].tolist():
                counts[g] = counts.get(g, 0) + 1
        for g, c in list(counts.items())[:50]:
            p = (c + langid.SMOOTHING) / (seen + langid.SMOOTHING * langid.BUCKETS)
            assert abs(2.718281828459045 ** float(model.log_p[k, g]) - p) < 1e-4 * p + 1e-9


def test_query_against_brute_force(spark, odd):
    """Scores from counts of n-grams in plain Python, with the n-grams' buckets."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect() if len(r["text"] or "") < 3000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    def buckets(text):
        chars, offsets = langid.letters(pa.array([text], pa.string()))
        return [g for n in langid.ORDERS for g in langid.grams(chars, offsets, n, langid.BUCKETS)[0].tolist()]

    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    counts, texts = {}, {}
    for doc, text, lang in rows:
        if lang is None or text is None or out(doc):
            continue
        texts[lang] = texts.get(lang, 0) + 1
        for g in buckets(text):
            counts.setdefault(lang, {})[g] = counts.get(lang, {}).get(g, 0) + 1
    names = sorted(texts)
    size = {k: sum(counts.get(k, {}).values()) + langid.SMOOTHING * langid.BUCKETS for k in names}
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in langid.identified(docs).collect()}
    for doc, text, _ in rows:
        grams = buckets(text) if text else []
        if not grams:
            assert got[doc, text] == (langid.UNKNOWN, 0.0)
            continue
        logs = {k: math.log(texts[k] / sum(texts.values())) + sum(math.log((counts.get(k, {}).get(g, 0) + langid.SMOOTHING) / size[k]) for g in grams) for k in names}
        best = max(names, key=lambda k: logs[k])
        name, score = got[doc, text]
        want = 1 / sum(math.exp(min(logs[k] - logs[best], 0)) for k in names)
        assert name == best or abs(logs[name] - logs[best]) < 1e-2
        assert abs(score - want) < 1e-2


def test_memory_does_not_grow_with_the_batch():
    """Texts of a batch are worked on a part at a time; the parts' results are those of the texts one by one."""
    texts = [f"{ENGLISH} {i} {GERMAN} " * 40 for i in range(800)] + ["", None, "1 2"]
    batch = pa.array(texts, pa.string())
    model = langid.Model(["a", "b"], np.log([0.4, 0.6]), np.random.default_rng(1).normal(size=(2, langid.BUCKETS)).astype(np.float32))
    langid.folding()
    tracemalloc.start()
    names, score = langid.scored(batch, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 4 << 20 and peak < 14 * batch.nbytes
    alone = [langid.scored(pa.array([t], pa.string()), model) for t in texts[:3] + texts[-3:]]
    assert [n for ns, _ in alone for n in ns] == names[:3] + names[-3:]
    assert np.concatenate([s for _, s in alone]).tolist() == [*score[:3], *score[-3:]]


def test_parts_are_all_texts_in_order(monkeypatch):
    monkeypatch.setattr(langid, "PART_BYTES", 10)
    texts = pa.array(["", "", "abc", "x" * 25, None, "defgh", "ij", "", "y" * 10, ""], pa.string())
    assert list(langid.parts(texts)) == [(0, 3), (3, 4), (4, 8), (8, 10)]
    assert list(langid.parts(texts.slice(5))) == [(0, 3), (3, 5)]
    assert list(langid.parts(texts.slice(0, 0))) == []
