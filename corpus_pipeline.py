"""From raw documents to packed windows: language, lines, near-duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridertide.llm import langid, lines, minhash, mixing, packing
from ridertide.llm.tables import documents, stage, table


def with_own_columns(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step(docs), for an operator that adds columns: the documents' own columns come back whatever their names."""
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang", "source")}
    out = step(docs.withColumnsRenamed(own))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter are in no language and go, as do those that no language explains better than
    chance among the learned ones."""
    good = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)
    return with_own_columns(docs, lambda d: langid.identified(d).where(good))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; a document of nothing else goes with them."""
    some = (F.col("n_dropped") == 0) | (F.trim("text") != "")
    return with_own_columns(docs, lambda d: lines.without_boilerplate(d).where(some))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates stays, that with the smallest doc_id (null before all). Rows
    that share a doc_id are documents of their own unless their texts are alike."""
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    kept = minhash.without_near_duplicates(docs.withColumnsRenamed(own))
    return kept.withColumnsRenamed({new: old for old, new in own.items()}).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by their rate in the mix of good, poor and toxic text. Every row has copies of
    its own, whatever its doc_id."""

    def repeated(d: DataFrame) -> DataFrame:
        counted = mixing.with_copies(d, table(spark, sf_dir, "labels"), "mix_copies").where("mix_copies > 0")
        return counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))

    return with_own_columns(docs, repeated)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of equal length."""
    return packing.packed(docs)


STAGES = [("language", language), ("lines", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Classifiers and near-duplicate classes are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
