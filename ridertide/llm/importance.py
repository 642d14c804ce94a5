"""Importance resampling: documents are drawn by the ratio of two hashed n-gram models.

Counts of hashed words and word pairs give one generative model of the target text (labelled good, not toxic) and one
of all raw text. A document's log weight is the sum of log p_target - log p_raw over its n-grams. Adding Gumbel noise
and taking the k largest draws k documents without replacement, in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridertide.llm.arrays import flat, mixed, span_hashes, words
from ridertide.llm.langid import by_text
from ridertide.llm.tables import arrow_batches, stage

#: Buckets of the n-gram models; labelled target documents that are used at most, those with the smallest hash first.
BUCKETS, TARGET_ROWS = 1 << 14, 20_000
SMOOTHING = 1.0
#: Rows left when the search for the k-th key ends with a sort.
LAST_ROWS = 20_000


def grams(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, number by text) of the words in ASCII lower case, then of the pairs of neighbouring words."""
    data, offsets = flat(texts)
    data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)
    starts, ends, n = words(data, offsets)
    word = span_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(n)), n)
    pair = mixed(word[:-1] * np.uint64(3) + word[1:])[text[1:] == text[:-1]]
    cut = lambda h: (h % np.uint64(buckets)).astype(np.int64)
    return cut(word), n, cut(pair), np.maximum(n - 1, 0)


def fit(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each bucket. docs: text, is_target. Raw counts cover all rows."""
    arrow_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            chosen = batch.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
            word, n, pair, m = grams(batch.column("text"), buckets)
            for gram, each in ((word, n), (pair, m)):
                raw += np.bincount(gram, minlength=buckets)
                target += np.bincount(gram[np.repeat(chosen, each)], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    sums = docs.select("text", "is_target").mapInArrow(counted, "bucket long, raw long, target long")
    found = sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow().sort_by("bucket")
    if not len(found):
        return np.zeros(buckets)
    raw, target = (found.column(c).to_numpy() + SMOOTHING for c in ("raw", "target"))
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weighted(docs: DataFrame, ratio: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_grams, log_weight, key (log weight plus Gumbel noise that depends on doc_id and seed; both null for a text
    without words, which no model can weigh)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n, pair, m = grams(batch.column("text"), len(shared.value))
            weight = by_text(shared.value[word], n) + by_text(shared.value[pair], m)
            number = batch.column("doc_id").fill_null(-(2**63)).to_numpy().astype(np.uint64)
            uniform = ((mixed(mixed(number + np.uint64(seed))) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
            wordless = n == 0
            key = weight - np.log(-np.log(uniform))
            columns = [batch.column("doc_id"), pa.array(n + m), pa.array(weight, mask=wordless), pa.array(key, mask=wordless)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_grams", "log_weight", "key"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double, key double")


def kth_largest(scores: DataFrame, k: int) -> float:
    """The k-th largest key of those that aren't null: quantile sketches narrow the range, exact counts keep the rank, a short sort ends it.

    Where a sketch doesn't narrow it, since many keys tie, the range is halved; a range of one value is the answer."""
    low, high = scores.agg(F.min("key"), F.max("key")).first()
    left = k
    while low < high:
        inside = scores.where(F.col("key").between(low, high))
        n = inside.count()
        if n <= LAST_ROWS:
            return inside.orderBy(F.desc("key")).select("key").limit(left).agg(F.min("key")).first()[0]
        share = 1 - left / n
        near = [max(0.0, share - 0.001), min(1.0, share + 0.001)]
        a, b = inside.agg(F.percentile_approx("key", near, 100_000)).first()[0]
        above, within = inside.agg(F.count_if(F.col("key") > b), F.count_if(F.col("key").between(a, b))).first()
        if above < left <= above + within and within < n:
            low, high, left = a, b, left - above
            continue
        middle = low + (high - low) / 2
        upper = inside.where(F.col("key") > middle).agg(F.count("key"), F.min("key")).first()
        if upper[0] >= left:
            low = upper[1]
        else:
            high, left = middle, left - upper[0]
            high = inside.where(F.col("key") <= middle).agg(F.max("key")).first()[0]
    return low


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 17, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept for every document; kept holds for the k largest keys.

    k is `share` of the documents with words; without one, the share of good rows among the labelled. A null text and
    one without words have no weight and are not kept; keys that tie at the end are all kept; a null doc_id draws like one number; rows that share a doc_id
    and text share their key; without labels all weights are 0; an empty table stays empty.
    """
    arrow_batches(docs.sparkSession)
    judged = labels.where("quality is not null and doc_id is not null")
    target = judged.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("labelled")).distinct()
    # At most TARGET_ROWS numbers, so this side is small whatever the tables hold.
    target = F.broadcast(target.orderBy(F.xxhash64("labelled"), "labelled").limit(TARGET_ROWS))
    known = docs.select("doc_id", "text").join(target, F.col("doc_id") == F.col("labelled"), "left")
    ratio = fit(known.select("text", F.col("labelled").isNotNull().alias("is_target")), buckets)
    scores = stage(weighted(docs, ratio, seed))
    total = scores.where("key is not null").count()
    if share is None:
        share = judged.agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))).first()[0]
    k = round(total * (1.0 if share is None else share))
    if not k:
        return scores.withColumn("kept", F.lit(False))
    return scores.withColumn("kept", F.coalesce(F.col("key") >= kth_largest(scores.where("key is not null"), k), F.lit(False)))
