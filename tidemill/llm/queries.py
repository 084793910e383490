"""The queries of the subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, language_id, mixing, packing, quality_rules, sharding, simhash, suffix_dedup, toxicity, url_filters
from .shared import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), digest=True).drop("uid")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", language_id.fold(F.col("doc_id"), 5) == 0)
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(language_id.fold(F.col("doc_id"), 5) != 0)
    machine = toxicity.train(docs.where(~F.col("held_out")), labels)
    scored = toxicity.score(docs, machine, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = sharding.shard_documents(_table(spark, sf_dir, "documents"), fresh_path(spark, "shards")).read()
    return live.select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("text_md5"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.fold(F.col("doc_id"), 3) == 1)
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, keep=("doc_id", "held_out"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("copies", lambda c: c["shard"].cast("string")), ",")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), shards.alias("shards"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"), url_filters.rules_frame(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_toxicity, op3_suffix_dedup, op4_sharding, op5_simhash, op6_quality_rules, op7_language_id, op8_embedding_dedup, op9_mixing, op10_url_filters)}

ORACLES: dict[str, str] = {
    "op4_sharding": sharding.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op8_embedding_dedup": embedding_dedup.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_url_filters": url_filters.ORACLE,
}
