"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. For each line (surrounding spaces aside) the pages of the host that contain it are divided
by the host's pages; a line above the boilerplate ratio, on LEAST pages at least, is dropped from all pages of that
host. A host has at most (lines of a page / ratio) such lines, so its list of them is small however many pages it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridertide.llm.tables import stage

#: Share of a host's pages above which a line is boilerplate, and the least number of pages that have it: on a host of
#: fewer than ten pages every line is on more than a tenth of them.
RATIO, LEAST = 0.1, 5


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """host_key, boiler: the lines to drop of each host that has any. Rows without a host are one host ("")."""
    key = F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host_key")
    lines = F.array_distinct(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)))
    found = docs.select(key, F.explode(lines).alias("line")).where("line <> ''")
    counts = found.groupBy("host_key", "line").agg(F.count("*").alias("on_pages")).where(F.col("on_pages") >= least)
    pages = docs.select(key).groupBy("host_key").agg(F.count("*").alias("pages"))
    often = counts.join(pages, "host_key").where(F.col("on_pages") > ratio * F.col("pages"))
    return often.groupBy("host_key").agg(F.collect_set("line").alias("boiler"))


def without_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """All rows and columns of docs, the text without its host's boilerplate lines, with n_lines and n_dropped.

    A null text stays null with 0 lines; a text may become empty and its row stays; blank lines are never dropped; the
    same line twice on a page counts once; repeated rows are pages of their own; columns named n_lines or n_dropped
    are replaced; an empty table stays empty.
    """
    # Written first: its size then decides whether Spark broadcasts it, and no page is moved if it does.
    drop = stage(boilerplate(docs, host, text, ratio, least))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    host_key, boiler, kept = (free_name(c, docs) for c in ("host_key", "boiler", "lines_kept"))
    pages = docs.select(*own, F.coalesce(F.col(host).cast("string"), F.lit("")).alias(host_key))
    joined = pages.join(drop.select(F.col("host_key").alias(host_key), F.col("boiler").alias(boiler)), host_key, "left")
    lines = F.split(F.col(text), "\n")
    left = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(boiler, F.trim(x)), F.lit(False)))
    joined = joined.withColumn("n_lines", F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("long"))
    joined = joined.withColumn(kept, left)
    joined = joined.withColumn("n_dropped", F.when(F.col(text).isNotNull(), F.col("n_lines") - F.size(kept)).otherwise(0).cast("long"))
    joined = joined.withColumn(text, F.array_join(kept, "\n"))
    return joined.select(*own, "n_lines", "n_dropped")


def free_name(name: str, docs: DataFrame) -> str:
    """The name, longer if the table has a column of that name."""
    while name in docs.columns:
        name += "_"
    return name
