"""Near-duplicate classes by ProbMinHash, banding and verification.

Each text is the set of its five-word shingles (its words in a row if there are fewer), weighted by 1 + ln(times it
occurs). An element with weight w arrives at registers as a Poisson process of rate w, seeded by its hash; a register
keeps its first arrival. Elements stop as soon as their next arrival is later than all registers of the text, so most
need one. Two registers agree with the probability Jaccard similarity of the texts.

That similarity can be far below the Jaccard similarity of the sets where one text repeats what the other does not. So
every text has the bands of its set, where all weights are 1, and a text whose shingles occur unequally often has those
of its weights too. Both kinds share their keys; of texts whose shingles occur equally often they are the same.

Texts that agree in a band share a bucket. Each is first compared with its bucket's leader, the member that meets most
texts in all its buckets. Where those links leave several classes in a bucket, members of the smaller classes are then
compared with all members of other classes, in blocks of at most BLOCK by BLOCK texts; only links leave a block, and no
link inside a class is looked for twice. A pair counts if the exact Jaccard similarity of the shingle sets is at least
SIMILARITY.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridertide.llm.arrays import flat, give_back, mixed, ranges, span_hashes, words
from ridertide.llm.components import components
from ridertide.llm.tables import arrow_batches, discard, release, stage

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of sets at the threshold misses all bands of weight 1 with probability (1 - 0.8 ** 6) ** 40, five in a million,
#: however often the texts repeat their shingles.
BANDS, ROWS = 40, 6
#: Texts on each side of a comparison in one task; shingles that are looked at together.
BLOCK, COLUMNS = 512, 4096


def shingles(texts: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, times, distinct shingles by text), ascending by text and hash."""
    data, offsets = flat(texts)
    starts, ends, n = words(data, offsets)
    word = span_hashes(data, starts, ends)
    first = np.cumsum(n) - n
    count = np.where(n >= length, n - length + 1, (n > 0).astype(np.int64))
    at = ranges(first, count)
    text = np.repeat(np.arange(len(n)), count)
    size = np.minimum(n, length)[text]
    hashed = np.full(len(at), 1, np.uint64)
    for k in range(length):
        more = size > k
        hashed[more] = mixed(hashed[more] * np.uint64(3) + word[at[more] + k])
    order = np.lexsort([hashed, text])
    hashed, text = hashed[order], text[order]
    new = np.flatnonzero(np.r_[True, (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])]) if len(hashed) else np.empty(0, np.int64)
    return hashed[new], np.diff(np.r_[new, len(hashed)]), np.bincount(text[new], minlength=len(n))


def signatures(hashed: np.ndarray, weight: np.ndarray, each: np.ndarray, registers: int) -> np.ndarray:
    """One row for each text: the element that each register keeps, 0 for texts without elements."""
    best = np.full(len(each) * registers, np.inf)
    winner = np.zeros(len(each) * registers, np.uint64)
    text = np.repeat(np.arange(len(each)), each)
    time = np.zeros(len(hashed))
    done = np.zeros(len(hashed), np.int64)
    live = np.arange(len(hashed))
    while len(live):
        # As many arrivals at a time as a text has registers, spread over its elements.
        batch = np.maximum(1, registers // np.maximum(np.bincount(text[live], minlength=len(each)), 1))[text[live]]
        element = np.repeat(live, batch)
        nth = ranges(done[live], batch)
        random = mixed(hashed[element] + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        wait = -np.log(((random >> np.uint64(24)).astype(np.float64) + 0.5) / 2.0**40)
        total = np.cumsum(wait)
        ends = np.cumsum(batch)
        begin = np.r_[0.0, total[ends[:-1] - 1]]
        arrival = (total - np.repeat(begin, batch) + np.repeat(time[live], batch)) / weight[element]
        place = text[element] * registers + (mixed(random) % np.uint64(registers)).astype(np.int64)
        sooner = arrival < best[place]
        place, arrival, element = place[sooner], arrival[sooner], element[sooner]
        np.minimum.at(best, place, arrival)
        won = best[place] == arrival
        winner[place[won]] = hashed[element[won]]
        time[live] += total[ends - 1] - begin
        done[live] += batch
        latest = best.reshape(-1, registers).max(1)
        live = live[time[live] / weight[live] < latest[text[live]]]
    return winner.reshape(-1, registers)


def bands_of(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band of a text."""
    parts = signature.reshape(len(signature), signature.shape[1] // rows, rows)
    out = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        out = mixed(out * np.uint64(3) + parts[:, :, k])
    return out


def band_keys(hashed: np.ndarray, times: np.ndarray, each: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, keys by text): of the set, and those of the weighted set that differ; none without a word."""
    full = each > 0
    text = np.repeat(np.arange(len(each)), each)
    uneven = np.zeros(len(each), bool)
    uneven[text[times != np.repeat(times[(np.cumsum(each) - each)[full]], each[full])]] = True
    keys = np.zeros((len(each), 2 * bands), np.uint64)
    keys[:, :bands] = bands_of(signatures(hashed, np.ones(len(hashed)), each, bands * rows), rows)
    mine = uneven[text]
    keys[uneven, bands:] = bands_of(signatures(hashed[mine], 1 + np.log(times[mine]), each[uneven], bands * rows), rows)
    kept = np.repeat(np.c_[full, uneven], bands, axis=1)
    kept[:, bands:] &= keys[:, bands:] != keys[:, :bands]
    return keys[kept], kept.sum(1)


def digest_of(text) -> Column:
    return F.unhex(F.sha2(text, 256))


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, digest of the text, n_shingles, bands (the text's distinct keys; none without a word), and row, a number of
    its own for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed, times, each = shingles(batch.column("text"))
            keys, counts = band_keys(hashed, times, each, bands, rows)
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))
            columns = [batch.column("doc_id"), batch.column("digest"), pa.array(each), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_shingles", "bands"])
        give_back()

    texts = docs.select("doc_id", digest_of("text").alias("digest"), "text")
    found = texts.mapInArrow(run, "doc_id long, digest binary, n_shingles long, bands array<long>")
    return found.withColumn("row", F.monotonically_increasing_id())


def shingle_sets(docs: DataFrame) -> DataFrame:
    """row, elements: the distinct shingle hashes of a text, ascending, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed, _, each = shingles(batch.column("text"))
            offsets = np.r_[0, np.cumsum(each) * 8]
            blob = pa.Array.from_buffers(pa.large_binary(), len(each), [None, pa.py_buffer(offsets), pa.py_buffer(hashed)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), blob.cast(pa.binary())], ["row", "elements"])
        give_back()

    return docs.select("row", "text").mapInArrow(run, "row long, elements binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose shingle sets are alike enough."""
    left = sets.select(F.col("row").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("row").alias("b"), F.col("elements").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                met = int((both[1:] == both[:-1]).sum())
                keep.append(met >= similarity * (len(both) - met))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def members_of(elements: pa.ChunkedArray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in `common`) of the shingles that are in `common`, and the size of each set."""
    data, offsets = flat(elements)
    hashed = np.frombuffer(data.tobytes(), np.uint64)
    sizes = np.diff(offsets) // 8
    place = np.minimum(np.searchsorted(common, hashed), max(len(common) - 1, 0))
    hit = common[place] == hashed if len(common) else np.zeros(len(hashed), bool)
    return np.repeat(np.arange(len(sizes)), sizes)[hit], place[hit], sizes


def linked(rows: pa.Table, similarity: float) -> pa.Table:
    """The links between the probes and the targets of a block, other than those inside a class."""
    sides = [rows.filter(pa.compute.equal(rows.column("side"), k)) for k in (0, 1)]
    sets = [np.frombuffer(flat(x.column("elements"))[0].tobytes(), np.uint64) for x in sides]
    common = np.intersect1d(*sets)
    (p, at_p, n), (q, at_q, m) = (members_of(x.column("elements"), common) for x in sides)
    met = np.zeros((len(n), len(m)), np.float32)
    order_p, order_q = np.argsort(at_p, kind="stable"), np.argsort(at_q, kind="stable")
    p, at_p, q, at_q = p[order_p], at_p[order_p], q[order_q], at_q[order_q]
    for first in range(0, len(common), COLUMNS):
        x, y = np.zeros((len(n), COLUMNS), np.float32), np.zeros((len(m), COLUMNS), np.float32)
        for to, of, at in ((x, p, at_p), (y, q, at_q)):
            i, j = np.searchsorted(at, [first, first + COLUMNS])
            to[of[i:j], at[i:j] - first] = 1
        met += x @ y.T
    union = n[:, None] + m[None, :] - met
    classes = [x.column("class_id").to_numpy() for x in sides]
    i, j = np.nonzero((met >= similarity * union) & (classes[0][:, None] != classes[1][None, :]))
    ids = [x.column("row").to_numpy() for x in sides]
    return pa.table({"a": ids[0][i], "b": ids[1][j]})


def across(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links a, b between the classes of each bucket. placed: bucket, row, class_id."""
    sizes = placed.groupBy("bucket", "class_id").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", "class_id")).alias("most"))
    buckets = buckets.where("all > most.n").select(
        "bucket",
        F.col("most.class_id").alias("largest"),
        F.ceil((F.col("all") - F.col("most.n")) / BLOCK).alias("probes"),
        F.ceil(F.col("all") / BLOCK).alias("targets"),
    )
    rows = placed.join(buckets, "bucket").join(sets, "row")
    own = lambda count: F.pmod(F.xxhash64("row"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    kept = ["bucket", "row", "class_id", "elements"]
    probe = rows.where("class_id <> largest").select(*kept, own("probes").alias("k"), every("targets").alias("j"), F.lit(0).alias("side"))
    target = rows.select(*kept, every("probes").alias("k"), own("targets").alias("j"), F.lit(1).alias("side"))

    def compare(block: pa.Table) -> pa.Table:
        return linked(block, similarity)

    return probe.unionByName(target).groupBy("bucket", "k", "j").applyInArrow(compare, "a long, b long")


def lowest() -> Column:
    """What a null doc_id stands as while documents are compared: below all others."""
    return F.lit(-(2**63)).cast("long")


def classified(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest, row, class_id, is_first for every row of docs (doc_id, text).

    Each row has a number of its own, so rows that share a doc_id have classes by their own texts. class_id is the
    smallest doc_id of the class; one row of the class, of those with that doc_id, is its first. A null doc_id is the
    smallest there is and stands as -2**63; a null text is empty."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest()).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = stage(signed(docs, bands, rows))
    # The first row of each text stands for its copies; they are merged before the exchange.
    order, value = F.struct("doc_id", "row"), F.struct("doc_id", "row", "n_shingles", "bands")
    texts = known.groupBy("digest").agg(F.min_by(value, order).alias("first"), F.count("*").alias("copies"))
    texts = stage(texts.select("digest", "copies", "first.*"))
    known = known.select("doc_id", "digest", "row")

    members = stage(texts.select("row", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stage(members.join(sizes, "bucket"))
    discard(members)
    release(docs.sparkSession)
    # The sets of all texts that share a bucket.
    degrees = stage(shared.groupBy("row").agg(F.sum("size").alias("degree")))
    wanted = stage(texts.select("doc_id", "digest", "row").join(degrees.select("row"), "row"))
    # The plan is that of large tables at every size: which texts are wanted grows with them.
    found = docs.join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    found = found.withColumn("digest", digest_of("text")).join(wanted, ["doc_id", "digest"])
    # Rows that repeat a doc_id with its text are one.
    sets = stage(shingle_sets(found).groupBy("row").agg(F.first("elements").alias("elements")))
    ranked = shared.join(degrees, "row")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("degree", F.bitwise_not("row"), "row", "n")).alias("leader"))
    star = shared.join(leaders, "bucket").select("row", "n", F.col("leader.row").alias("leader"), F.col("leader.n").alias("m"))
    # Sets that are alike have about as many elements.
    star = star.where("row <> leader").where(f"least(n, m) >= {similarity} * greatest(n, m)")
    star = star.select(F.col("row").alias("a"), F.col("leader").alias("b")).distinct()
    classes = components(verified(star, sets, similarity))
    placed = shared.select("bucket", "row").join(classes.withColumnRenamed("node", "row"), "row", "left")
    placed = stage(placed.withColumn("class_id", F.coalesce("class_id", "row")))
    links = across(placed, sets, similarity).unionByName(classes.select(F.col("node").alias("a"), F.col("class_id").alias("b")))
    # A text's copies are rows of one key; both sides are plain tables, so that the join can split a frequent one.
    repeated = stage(texts.where("copies > 1").select("digest", F.col("row").alias("b")))
    copies = known.join(repeated, "digest").where("row <> b").select(F.col("row").alias("a"), "b")
    linked_ = stage(links.unionByName(copies))
    discard(shared, placed, sets, texts, wanted)
    release(docs.sparkSession)
    ends = components(linked_)
    nodes = ends.unionByName(ends.select(F.col("class_id").alias("node"), "class_id").distinct()).withColumnRenamed("node", "row")
    nodes = stage(nodes.join(known.select("row", "doc_id"), "row"))
    heads = stage(nodes.groupBy("class_id").agg(F.min(F.struct("doc_id", "row")).alias("head")))
    placed = nodes.join(heads, "class_id").select("row", "head")
    head = F.coalesce("head", F.struct("doc_id", "row"))
    result = known.join(placed, "row", "left").withColumn("head", head)
    return result.select("doc_id", "digest", "row", F.col("head.doc_id").alias("class_id"), (F.col("head.row") == F.col("row")).alias("is_first"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id for every row: the smallest doc_id of the class.

    Equal texts are one class and searched once. A null text is empty; texts without words are alike only if equal.
    Rows that share a doc_id are documents of their own, each in the class of its text. A null doc_id counts as the
    smallest and is the class_id of its class. Other columns are ignored; an empty table stays empty.
    """
    arrow_batches(docs.sparkSession)
    found = classified(docs, similarity, bands, rows)
    return found.select(F.nullif("doc_id", lowest()).alias("doc_id"), F.nullif("class_id", lowest()).alias("class_id"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that come first in their class of near-duplicates, with all columns.

    Of rows that share a doc_id and a text one stays, any of them; rows that share a doc_id with different texts are
    documents of their own."""
    arrow_batches(docs.sparkSession)
    found = stage(classified(docs))
    key = [F.coalesce(F.col("doc_id").cast("long"), lowest()).alias("own_id"), digest_of(F.coalesce("text", F.lit(""))).alias("own_digest")]
    named = [F.col("doc_id").alias("own_id"), F.col("digest").alias("own_digest")]
    firsts = found.groupBy("doc_id", "digest").agg(F.max("is_first").alias("has_first"), F.count("*").alias("rows"))
    marks = stage(firsts.where("not has_first or rows > 1").select(*named, "has_first"))
    keyed = docs.select("*", *key)
    # What is marked goes; where a row and its repetitions have the first among them, one comes back.
    once = keyed.join(marks.hint("merge"), ["own_id", "own_digest"], "left_anti")
    again = keyed.join(marks.where("has_first"), ["own_id", "own_digest"], "left_semi").dropDuplicates(["own_id", "own_digest"])
    return once.unionByName(again).select(docs.columns)
