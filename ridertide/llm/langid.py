"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are folded to lower case and everything but letters becomes one separator. Counts of hashed n-grams by
language are summed over all training texts; the matrix of log-probabilities is broadcast (languages times buckets,
checked against MOST_CELLS) and texts are scored about PART_BYTES at a time: gather the rows of their n-grams, sum by
text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ridertide.llm.arrays import flat, give_back, ranges
from ridertide.llm.tables import arrow_batches, stage

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
SMOOTHING = 0.5
#: Cells of the broadcast matrix (4 bytes each); more languages than fit are an error, not a cut.
MOST_CELLS = 1 << 25
#: Bytes of text that are worked on at once; arrays take about 40 bytes for each.
PART_BYTES = 1 << 20


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    #: One row for each language, one column for each bucket.
    log_p: np.ndarray


@cache
def folding() -> np.ndarray:
    """For each code point its lower case, 0 if it is no letter; letters that fold to several characters stay."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            table[i] = ord(c.lower()) if len(c.lower()) == 1 else i
    return table


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of whole texts of PART_BYTES at most, of one text at least."""
    offsets, start = flat(texts)[1], 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PART_BYTES, "right")) - 1)
        yield start, stop
        start = stop


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(folded characters, offsets by text): letters in lower case, a single 0 for whatever is between words.

    Each text starts and ends with a 0, so that n-grams see word edges and never cross texts."""
    data, offsets = flat(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    bounds = lead[offsets]
    framed = np.zeros(len(points) + 2 * len(texts), np.uint32)
    inside = ranges(bounds[:-1] + 2 * np.arange(len(texts)) + 1, np.diff(bounds))
    framed[inside] = folding()[points]
    edge = bounds + 2 * np.arange(len(texts) + 1)
    keep = np.ones(len(framed), bool)
    keep[1:] = (framed[1:] != 0) | (framed[:-1] != 0)
    keep[edge[:-1]] = True  # also where two texts meet
    kept = np.zeros(len(framed) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return framed[keep], kept[edge]


def grams(chars: np.ndarray, offsets: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram with a letter, n-grams by text)."""
    n = len(chars) - order + 1
    if n <= 0:
        return np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    h = np.full(n, order, np.uint64)
    some = np.zeros(n, bool)
    for k in range(order):
        c = chars[k : k + n]
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        some |= c != 0
    # N-grams that would run over the end of a text are left out.
    ends = offsets[1:]
    for k in range(1, order):
        late = ends - k
        some[late[(late >= offsets[:-1]) & (late < n)]] = False
    total = np.zeros(n + 1, np.int64)
    np.cumsum(some, out=total[1:])
    at = total[np.minimum(offsets, n)]
    return (h[some] % np.uint64(buckets)).astype(np.int64), np.diff(at)


def by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, counts[i] of them for text i."""
    out = np.zeros(len(counts))
    full = counts > 0
    if full.any():
        first = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, first, dtype=np.float64)
    return out


def fit(training: DataFrame, label: str = "lang", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> Model | None:
    """Counts over all rows with a text and a label; None if there is no such row."""
    arrow_batches(training.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column("label").dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            counts = np.zeros((len(names), buckets + 1), np.int64)
            counts[:, buckets] = np.bincount(codes, minlength=len(names))
            for a, b in parts(batch.column("text")):
                chars, offsets = letters(batch.column("text").slice(a, b - a))
                for order in ORDERS:
                    gram, each = grams(chars, offsets, order, buckets)
                    cell = gram + np.repeat(codes[a:b].astype(np.int64) * (buckets + 1), each)
                    counts += np.bincount(cell, minlength=counts.size).reshape(counts.shape)
            for name, row in zip(names, counts, strict=True):
                sums[name] = sums[name] + row if name in sums else row
        for name, row in sums.items():
            cell = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell), pa.string()), pa.array(cell), pa.array(row[cell])], ["label", "cell", "n"])
        give_back()

    rows = training.select(F.col(label).cast("string").alias("label"), "text").where("label is not null and text is not null")
    # Written once: the number of languages is checked before the counts come to the driver.
    sums = stage(rows.mapInArrow(counted, "label string, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")))
    languages = sorted(r[0] for r in sums.where(F.col("cell") == buckets).select("label").limit(MOST_CELLS // buckets + 1).collect())
    if len(languages) * buckets > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS // buckets} languages for {buckets} buckets")
    if not languages:
        return None
    found = sums.toArrow()
    row = np.searchsorted(np.array(languages), np.array(found.column("label").to_pylist()))
    counts = np.zeros((len(languages), buckets + 1))
    counts[row, found.column("cell").to_numpy()] = found.column("n").to_numpy()
    texts, grams_ = counts[:, buckets], counts[:, :buckets] + smoothing
    return Model(languages, np.log(texts / texts.sum()), np.log(grams_ / grams_.sum(1, keepdims=True)).astype(np.float32))


def scored(texts: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray]:
    """(language, posterior probability) of each text; UNKNOWN and 0 without a letter or a model."""
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    found = [scored_part(texts.slice(a, b - a), model) for a, b in parts(texts)]
    return [name for names, _ in found for name in names], np.concatenate([np.zeros(0), *(score for _, score in found)])


def scored_part(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """The same for texts that are worked on at once."""
    chars, offsets = letters(texts)
    total = np.tile(model.prior[:, None], len(texts))
    seen = np.zeros(len(texts), np.int64)
    for order in ORDERS:
        gram, each = grams(chars, offsets, order, model.log_p.shape[1])
        seen += each
        for k, row in enumerate(model.log_p):
            total[k] += by_text(row[gram], each)
    best = total.argmax(0)
    posterior = 1 / np.exp(np.minimum(total - total.max(0), 0)).sum(0)
    known = seen > 0
    return [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], np.where(known, posterior, 0.0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All rows and columns of docs, with lang_pred and score. A null text, or one without a letter, is `und` with
    score 0; ties go to the language that sorts first; columns of those two names are replaced; an empty table
    stays empty. Without a model (no labelled text) every row is `und`."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = scored(batch.column("text"), shared.value)
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])
        give_back()

    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def held_out(key: str = "doc_id"):
    """A quarter of the documents, by the CRC of their number as text; a null number is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """Fit on the documents that aren't held out, then predict all of them."""
    return predict(docs, fit(docs.where(~held_out())))
