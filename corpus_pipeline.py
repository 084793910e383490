"""From documents to packed sequences: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.

Every stage takes any rows: a null text counts as empty (it is scored like an empty one, is a near duplicate of all texts
without words, has no passages, is never taken into the mix); a null id is kept, larger than all others; a null source is a
source of its own; of repeated rows one stays after the SimHash stage; very long texts are read whole; an empty table, or a
stage that leaves nothing, gives no rows with the same columns; columns beyond ``COLUMNS`` are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import language_id, mixing, packing, simhash, suffix_dedup, toxicity
from tidemill.llm.shared import drop_written, fresh_path, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "toxic").where(language_id.fold(F.col("doc_id"), 5) != 0)
    machine = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, machine, keep=tuple(COLUMNS)).where("score < 0.5").select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash.near_duplicates(docs, keep=("text", "lang", "source", "n_chars")).where("kept").select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has go from the text; documents stay."""
    left = suffix_dedup.remove_repeats(docs, keep=("doc_id", "lang", "source"), as_text=True)
    return left.withColumnRenamed("kept_text", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as shards take it; the rows stand shard by shard, each in its shuffled order, in which packing meets them."""
    return mixing.shard_rows(mixing.mix(docs, keep=tuple(COLUMNS))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in their sequences; ``uid`` tells the copies of a document apart."""
    return packing.pack(docs, digest=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("suffix-array dedup", suffix_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: SQL expresses none of the first three stages; tests/llm compares run()'s pieces with a brute-force version, all stages
#: but the toxicity decision, which is compared on its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on its way goes when its result is written, and that when the next stage's is."""
    docs = before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name.split()[0]}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        if docs is not before:
            drop_written(docs)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
