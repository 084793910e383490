"""Usage costs: traces priced by a rate card. An unknown model has no cost, which is not a cost of 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("input", "output", "cache_creation", "cache_read")
ALIASES = {"prompt_tokens": "input_tokens", "completion_tokens": "output_tokens"}
TRACE = (
    "type string, sessionId string, requestId string, timestamp string, gitBranch string, "
    "message struct<model string, usage struct<input_tokens long, output_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long>>"
)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON lines; blank and malformed lines and those without usage are skipped."""
    raw = spark.read.schema(TRACE).json(path).where("type = 'assistant' and message.usage is not null")
    u = "message.usage."
    return raw.select(F.col("sessionId").alias("session"), F.col("gitBranch").alias("branch"), F.col("timestamp").cast("timestamp").alias("at"), F.col("message.model").alias("model"), *[F.coalesce(u + c, F.lit(0)).alias(a) for c, a in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_creation_input_tokens", "cache_creation_tokens"), ("cache_read_input_tokens", "cache_read_tokens"))])


def read_flat(df: DataFrame) -> DataFrame:
    """Flat rows under other names; missing token columns and values are 0."""
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.withColumns({f"{k}_tokens": F.coalesce(F.try_to_number(F.col(f"{k}_tokens").cast("string"), F.lit("999999999999")).cast("long"), F.lit(0)) if f"{k}_tokens" in df.columns else F.lit(0).cast("long") for k in KINDS})


def rate_card(spark: SparkSession, card: dict) -> DataFrame:
    """One row per model; a card without a source, or a model without one of the four rates, is refused."""
    if not card.get("source"):
        raise ValueError("a rate card names its source")
    for name, rates in card["models"].items():
        if missing := [k for k in KINDS if k not in rates]:
            raise ValueError(f"{name}: no rate for {', '.join(missing)}")
    return spark.createDataFrame([(n, *[float(r[k]) for k in KINDS]) for n, r in card["models"].items()], "model string, " + ", ".join(f"{k}_rate double" for k in KINDS))


def priced(usage: DataFrame, rates: DataFrame) -> DataFrame:
    cost = sum((F.col(f"{k}_tokens") / F.lit(1e6) * F.col(f"{k}_rate") for k in KINDS[1:]), F.col("input_tokens") / F.lit(1e6) * F.col("input_rate"))
    return usage.join(rates, "model", "left").withColumn("cost", cost).withColumn("priced", F.col("cost").isNotNull()).drop(*[f"{k}_rate" for k in KINDS])


def _sums(rows: DataFrame, key: str, *more) -> DataFrame:
    unpriced = F.sum(F.when(F.col("priced"), 0).otherwise(1)).alias("unpriced")
    return rows.groupBy(key).agg(*more, F.count(F.lit(1)).alias("turns"), F.sum("cost").alias("cost"), unpriced).orderBy(F.desc_nulls_last("cost"), key)


def by_model(rows: DataFrame) -> DataFrame:
    """Turns, tokens of each kind and cost of each model."""
    return _sums(rows, "model", *[F.sum(f"{k}_tokens").alias(f"{k}_tokens") for k in KINDS])


def by_session(rows: DataFrame, at: str = "at") -> DataFrame:
    """Start, turns and cost of each session."""
    return _sums(rows, "session", F.min(at).alias("started_at"))


def cost_by(rows: DataFrame, key: str, missing: str | None = None) -> DataFrame:
    k = F.coalesce(F.col(key), F.lit(missing)) if missing else F.col(key)
    return rows.groupBy(k.alias(key)).agg(F.count(F.lit(1)).alias("turns"), F.sum("cost").alias("cost"), F.sum(F.when(F.col("priced"), 0).otherwise(1)).alias("unpriced")).orderBy(F.desc_nulls_last("cost"), key)
