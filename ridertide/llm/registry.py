"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ridertide.llm import cascade, grammar, importance, langid, lines, minhash, mixing, oracle, packing, pst, repair, sketch, suffix, whitening
from ridertide.llm.tables import documents, shared_path, table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op4_grammar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "grammar")
    grammar.write_files(documents(spark, sf_dir), path)
    return grammar.read_files(spark, path)


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.judged(documents(spark, sf_dir)).drop("rejected_by", "n_lines")


def op7_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(documents(spark, sf_dir))


def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return langid.identified(docs).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


def op13_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.scored(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_importance": op2_importance,
    "op3_packing": op3_packing,
    "op4_grammar_files": op4_grammar_files,
    "op5_soft_mixing": op5_soft_mixing,
    "op6_quality_cascade": op6_quality_cascade,
    "op7_scaled_sketch": op7_scaled_sketch,
    "op8_site_lines": op8_site_lines,
    "op9_suffix_repeats": op9_suffix_repeats,
    "op10_language_id": op10_language_id,
    "op11_whitening": op11_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_suffix_tree_scores": op13_suffix_tree_scores,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op6_quality_cascade": oracle.CASCADE,
    "op7_scaled_sketch": oracle.SKETCH,
    "op8_site_lines": oracle.LINES,
}
