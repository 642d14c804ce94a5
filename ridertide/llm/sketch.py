"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch holds the hashes of a text's five-word shingles (its words in a row if there are fewer) that lie below a
fixed fraction of the hash range, so sketches of different texts are comparable hash by hash, merge by union, and
estimate containment however unequal the texts are. A text with few shingles keeps its FLOOR smallest hashes, which
makes short texts exact and leaves no sketch of a text with words empty. Hashes are the first 16 hexadecimal digits
of MD5, which compare as strings in the order of their values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridertide.llm.tables import stage, text_bytes

SHINGLE, FLOOR, FRACTION = 5, 16, 1 / 16
#: Text of a range of doc_id.
PART_BYTES = 4 << 20
GAPS = "\t\n\x0b\x0c\r"
#: Above every hash.
TOP = "~"


def limit_of(fraction: float) -> str:
    """The hash below which hashes are retained, in 16 hexadecimal digits."""
    return f"{int(fraction * 2**64):016x}" if fraction < 1 else TOP


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used, in lambdas too.

    Columns that a lambda needs come in by this value, in a struct if there are several. Spark numbers lambda variables
    from 0 when it compares expressions; in a new session columns have such numbers too, and one that stands inside a
    lambda is then taken for a variable and overlooked, so that conditions on it are derived where it does not exist.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, GAPS, " " * len(GAPS)), " "), lambda w: w != "")


def shingle_hashes(tokens: Column, length: int = SHINGLE) -> Column:
    """Distinct hashes of the shingles of an array of words; none without a word."""

    def digest(part: Column) -> Column:
        return F.substring(F.md5(F.array_join(part, " ")), 1, 16)

    def of(t: Column) -> Column:
        whole = F.when(F.size(t) > 0, F.array(digest(t))).otherwise(F.array().cast("array<string>"))
        rolled = F.transform(F.sequence(F.lit(1), F.size(t) - (length - 1)), lambda i: digest(F.slice(t, i, length)))
        return F.array_distinct(F.when(F.size(t) >= length, rolled).otherwise(whole))

    return once(tokens, of)


def retained(hashes: Column, fraction: float = FRACTION) -> Column:
    """The sketch: hashes below the limit, or the FLOOR smallest if fewer than FLOOR are below; ascending."""

    def of(all_: Column) -> Column:
        floor = F.slice(F.sort_array(all_), 1, FLOOR)
        below = F.filter(all_, lambda h: h < limit_of(fraction))
        return once(below, lambda b: F.when(F.size(b) >= FLOOR, F.sort_array(b)).otherwise(floor))

    return once(hashes, of)


def complete_below(sketch: Column, fraction: float = FRACTION) -> Column:
    """The hash below which a sketch lacks nothing."""
    last = F.concat(F.element_at(sketch, -1), F.lit(TOP))
    return F.when(F.size(sketch) < FLOOR, F.lit(TOP)).otherwise(F.greatest(F.lit(limit_of(fraction)), last))


def shared(a: Column, b: Column, fraction: float = FRACTION) -> tuple[Column, Column]:
    """Both sketches, cut to the range in which both are complete, as x and y."""
    bound = F.least(complete_below(a, fraction), complete_below(b, fraction))
    return cut(a, bound).alias("x"), cut(b, bound).alias("y")


def cut(hashes: Column, bound: Column) -> Column:
    """The hashes below the bound."""
    both = F.struct(hashes.alias("hashes"), bound.alias("bound"))
    return once(both, lambda p: F.filter(p["hashes"], lambda h: h < p["bound"]))


def alike(pair: Column) -> Column:
    union = F.size(F.array_union(pair["x"], pair["y"]))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(pair["x"], pair["y"])) / union)


def contained(pair: Column) -> Column:
    of = F.size(pair["x"])
    return F.when(of == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(pair["x"], pair["y"])) / of)


def resemblance(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated Jaccard similarity of two shingle sets; two empty ones are alike."""
    return once(F.struct(*shared(a, b, fraction)), alike)


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return once(F.struct(*shared(a, b, fraction)), contained)


def merged(sketches: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the union of several texts' shingles, from an array of their sketches."""
    bound = F.array_min(F.transform(sketches, lambda s: complete_below(s, fraction)))
    return F.array_sort(F.array_distinct(cut(F.flatten(sketches), bound)))


def cuts_of(keys: DataFrame, parts: int) -> list[int]:
    """Ascending keys that cut the rows into about equal parts."""
    if parts < 2:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return sorted(set(keys.agg(F.percentile_approx("key", shares, max(10_000, 20 * parts))).first()[0] or []))


def part_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts below the key, by binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    below = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")

    def search(key: Column) -> Column:
        def further(found: Column, step: Column) -> Column:
            ahead = found + step
            inside = ahead <= len(cuts)
            return F.when(inside & (F.element_at(below, F.least(ahead, F.lit(len(cuts)))) < key), ahead).otherwise(found)

        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)

    return once(key, search)


def links_of(base: DataFrame) -> DataFrame:
    """part, link: the first text of the next part, after the last part that of the first. base: part, key, text."""
    # One task orders the part numbers; texts are joined to them.
    ends = Window.orderBy("part")
    numbers = base.select("part").distinct()
    following = numbers.select("part", F.coalesce(F.lead("part").over(ends), F.first("part").over(ends)).alias("next_part"))
    firsts = base.groupBy("part").agg(F.min(F.struct("key", "text")).alias("first"))
    return following.join(firsts.select(F.col("part").alias("next_part"), F.col("first.text").alias("link")), "next_part").select("part", "link")


def fingerprints(docs: DataFrame, fraction: float = FRACTION, part_bytes: int = PART_BYTES) -> DataFrame:
    """Sketches of every text and of the same text with its second half replaced by the start of the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (resemblance),
    contained_edited, contained_next (share of the text's shingles found there). A null text is empty; empty texts
    have the empty fingerprint and are alike. Documents follow each other by doc_id, a null one first, and by text
    where a doc_id repeats. Other columns are ignored; an empty table stays empty.

    Texts move once, to parts that are ranges of doc_id; one row for each part links it to the next.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")))
    cuts = cuts_of(base.select("key"), -(-text_bytes(base) // part_bytes))
    base = base.withColumn("part", part_of(F.col("key"), cuts))
    of = lambda column: retained(shingle_hashes(words(F.col(column))), fraction)
    links = links_of(base)
    links = stage(links.withColumn("link_sketch", of("link")))
    inside = Window.partitionBy("part").orderBy("key", "text")
    chained = base.repartition("part").withColumn("sketch", of("text"))
    chained = chained.withColumn("after", F.lead("text").over(inside)).withColumn("after_sketch", F.lead("sketch").over(inside))
    joined = chained.join(links, "part").withColumn("n_chars", F.length("text").cast("long"))
    half = "cast(floor(n_chars / 2) as int)"
    edited = F.concat(F.expr(f"left(text, cast(n_chars as int) - {half})"), F.expr(f"left(coalesce(after, link), {half})"))
    both = joined.withColumn("edited", edited).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "sketch",
        of("edited").alias("edited_sketch"),
        F.coalesce("after_sketch", "link_sketch").alias("next_sketch"),
    )
    sketch, other, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join(sketch, "").alias("fingerprint"),
        F.array_join(other, "").alias("edited_fingerprint"),
        resemblance(sketch, other, fraction).alias("near_edited"),
        resemblance(sketch, after, fraction).alias("near_next"),
        containment(sketch, other, fraction).alias("contained_edited"),
        containment(sketch, after, fraction).alias("contained_next"),
    )
