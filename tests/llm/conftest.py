"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, part long"
VOCABULARY = "der die und mit nicht ist the of and to in that le la et les des que el de los que y en".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "a", "er", "ion", "."]) for _ in range(n))


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    passage = sentence(rng, 60)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = sentence(rng, 6000)
    texts = [
        base,
        " ".join(near),
        base,
        None,
        "",
        " \n\t ",
        "one",
        "one two",
        "12 34 ...",
        passage + " " + sentence(rng, 80),
        sentence(rng, 70) + "\n" + passage + "\n" + sentence(rng, 30),
        long,
        long[:20_000],
        "é日本語 ßÀ İ 🙂 ﬁ" * 9,
        "aaaa " * 200,
        "x\x00y " * 30,
        *[sentence(rng, rng.randint(5, 90)) + "\nshared line of the site\n" + sentence(rng, 9) for _ in range(14)],
    ]
    rows = [(3 * i + 1, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], -1, 0.5, "k", 9) for i, t in enumerate(texts)]
    rows.append((None, base, None, None, None, None, None, None))
    rows.append(rows[10])  # a repeated row
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def unique_rows():
    """Rows with a doc_id of their own."""
    return [r for i, r in enumerate(odd_rows()[:-2])]


@pytest.fixture(scope="session")
def unique(spark, unique_rows):
    return spark.createDataFrame(unique_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (7, 1, 1), (43, 0, 0), (34, 0, 1), (46, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
