"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree. DataFrame operations only.

1. Sizes by source give targets: shares of the total by weight, each at most three times its source's size, what is
   above the cap shared again among the others (:func:`source_targets`).
2. Each source's documents stand in a permuted order, by a hash of id and text. Read up to three times over, that order
   is cut into blocks of equal length in words; a source's exact quota is the blocks that make up its target.
3. A tree splits the blocks of all sources among the output shards (:func:`draw_blocks`): a node's left half draws its
   exact number of the node's blocks without replacement, so that how many of each source go left is multivariate
   hypergeometric, and the shards' blocks are disjoint and together the quotas.
4. A copy of a document is taken by the shard that drew the block in which its middle lies, and by no shard if its middle
   lies beyond the quota. Each shard orders what it takes by another hash: a shuffle within the shard.

Scale: a source's order is found in two levels: sums by (source, bucket of the hash), then running sums in each bucket,
so a source with a third of all rows is split over all tasks. The tree handles ``BLOCKS`` blocks and one more for each
source, whatever the number of documents; its draws are windows over these rows. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, at_least, estimated_bytes, written

#: No document is taken more often.
MOST_REPEATS = 3
#: Blocks that all targets together are cut into, and one more for each source.
BLOCKS = 1 << 13
SHARDS = 16
ROWS_PER_BUCKET = 20_000
#: Bytes of a partition of the shards, as estimated from the input.
SHARD_BYTES = 64 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permutation_key(seed: int, *columns: Column) -> Column:
    """60 bits of an md5 of the columns, as a long."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """From ``source_key``, ``source``, ``source_size``: with ``weight`` and ``target``.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... With sources sorted by the level at which they reach
    their cap, the level of the others after the first i are capped is (total - caps so far) / weights left; the
    first level that its own source can bear is the level of all later sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(MOST_REPEATS)))
    bears = F.col("cap") / F.col("weight")
    rising = Window.orderBy(bears, F.col("source").asc_nulls_last())
    before, onwards, everything = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    levels = (
        weighed.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("rank", F.row_number().over(rising))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards))
        .withColumn("found", F.min(F.when(F.col("level") <= bears, F.struct("rank", "level"))).over(everything))
    )
    return levels.select("source_key", "source", "source_size", "weight", F.coalesce(F.least("cap", F.col("found.level") * F.col("weight")), F.col("cap")).alias("target"))


def source_blocks(targets: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """With ``quota`` (blocks of the source) and ``block`` (words of each, so that the quota is the target)."""
    share = F.col("target") / F.sum("target").over(Window.partitionBy()) * F.lit(float(blocks))
    quota = F.when(F.col("target") > 0, F.greatest(F.lit(1.0), F.round(share))).otherwise(0.0).cast("long")
    return targets.withColumn("quota", quota).withColumn("block", F.when(F.col("quota") > 0, F.col("target") / F.col("quota")).otherwise(1.0))


def draw_blocks(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``source_key``, ``nth``, ``shard`` of every block of ``quotas`` (``source_key``, ``quota``).

    A node is a range of shards. Of its n blocks its left half, l of its k shards, draws floor(n * l / k): the first by a
    hash that differs by node. A shard is a node that cannot be split; the shards' sizes differ by a rounding a level.
    """
    held = quotas.where("quota > 0").select("source_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("nth"), F.lit(0).alias("first"), F.lit(shards).alias("k"))
    for _ in range((shards - 1).bit_length()):
        node = Window.partitionBy("first", "k")
        dice = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("first").cast("string"), F.col("k").cast("string"), "source_key", F.col("nth").cast("string")))
        half = F.floor(F.col("k") / 2).cast("int")
        drawn = F.row_number().over(node.orderBy(dice, "source_key", "nth")) <= F.floor(F.count(F.lit(1)).over(node) * half / F.col("k"))
        held = held.select("source_key", "nth", F.when(drawn, F.col("first")).otherwise(F.col("first") + half).alias("first"), F.when(F.col("k") == 1, 1).when(drawn, half).otherwise(F.col("k") - half).alias("k"))
    return held.select("source_key", "nth", F.col("first").alias("shard"))


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 7, keep: tuple[str, ...] = ("doc_id",), text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: ``keep``, ``size``, ``source_size``, ``target``, ``copies``.

    ``copies`` is an array of (``repeat``, ``shard``, ``position``), empty for a document that no shard drew;
    :func:`shard_rows` gives the shards. The first of ``keep`` is the id. Null texts have size 0 and are never taken; a null
    source is a source of its own; null ids take part like any other; equal rows count as different documents, which only
    their number tells apart; an empty table gives no rows; other columns are not read.
    """
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    keys = [f"k{i}" for i in range(len(keep))]
    base = docs.select(*named, F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tie"))
    base = written(base.select(*keys, "source", "size", "tie", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"), permutation_key(seed, F.col("k0"), F.col("tie")).alias("perm")), "mix-sizes")
    bits = max(8, (at_least(1, base.count(), ROWS_PER_BUCKET) - 1).bit_length() + 4)
    base = base.withColumn("bucket", F.shiftright("perm", 60 - bits))
    buckets = base.groupBy("source_key", "source", "bucket").agg(F.sum("size").alias("words"))
    buckets = written(buckets, "mix-buckets")
    sources = written(source_blocks(source_targets(buckets.groupBy("source_key", "source").agg(F.sum("words").alias("source_size")))), "mix-sources")
    # A source's owners in one row, in the order of its blocks: at most BLOCKS numbers and one a source in all.
    drawn = draw_blocks(sources.select("source_key", "quota"), shards, seed).groupBy("source_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "shard"))), lambda b: b["shard"]).alias("owners"))
    owners = written(sources.join(drawn, "source_key", "left").select("source_key", "source_size", "target", "block", F.coalesce("owners", F.array().cast("array<int>")).alias("owners")), "mix-owners")

    offsets = (
        buckets.withColumn("words_before", F.coalesce(F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("source_key", "bucket", "words_before")
    )
    in_bucket = Window.partitionBy("source_key", "bucket").orderBy("perm", "k0", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    within = base.withColumn("within", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    placed = within.join(offsets, ["source_key", "bucket"]).join(owners, "source_key")
    # The copy's middle says which block it is in, so the words that a shard takes come within a document of its blocks'.
    middle = lambda e: e * F.col("source_size") + F.col("words_before") + F.col("within") + F.col("size") / F.lit(2.0)
    drawn_by = F.transform(
        F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)),
        lambda e: F.struct(
            e.alias("repeat"),
            F.when((F.col("size") > 0) & (middle(e) < F.col("target")), F.get("owners", F.least(F.floor(middle(e) / F.col("block")), F.size("owners") - 1).cast("int"))).alias("shard"),
            permutation_key(seed, F.lit("position"), F.col("k0"), F.col("tie"), e).alias("position"),
        ),
    )
    return placed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", F.filter(drawn_by, lambda c: c["shard"].isNotNull()).alias("copies"))


def shard_rows(mixed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for each copy, with ``repeat``, ``shard``, ``position``: shards one after another, each in its shuffled order.

    A shard that is larger than a partition's share spans several; ``position`` is uniform, so its pieces are equal.
    """
    rest = [c for c in mixed.columns if c != "copies"]
    rows = mixed.select(*rest, F.explode("copies").alias("c")).select(*rest, "c.*")
    parts = at_least(shards, estimated_bytes(mixed), SHARD_BYTES)
    return rows.repartitionByRange(parts, "shard", "position").sortWithinPartitions("shard", "position")


def _oracle(shards: int = SHARDS, seed: int = 7) -> str:
    levels, last = [], "h0"
    for i in range((shards - 1).bit_length()):
        levels.append(f"""
h{i + 1} AS (
  SELECT source, nth, CASE WHEN drawn THEN first ELSE first + k // 2 END AS first, CASE WHEN k = 1 THEN 1 WHEN drawn THEN k // 2 ELSE k - k // 2 END AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY first, k ORDER BY md5('{seed}:' || first || ':' || k || ':' || key || ':' || nth), key, nth)
                  <= floor(count(*) OVER (PARTITION BY first, k) * (k // 2) / k) AS drawn
        FROM (SELECT *, coalesce('=' || source, '') AS key FROM {last}))),""")
        last = f"h{i + 1}"
    copies = " UNION ALL ".join(f"SELECT *, {e} AS repeat, {e} * source_size + first + size / 2.0::DOUBLE AS middle FROM c" for e in range(MOST_REPEATS))
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS tie,
         ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS perm
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
l AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total,
         row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS rn
  FROM s),
v AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM l),
t0 AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, rn) FROM v WHERE level <= cap / weight) * weight) AS target FROM v),
t AS (SELECT *, CASE WHEN target > 0 THEN greatest(1.0, round(target / (sum(target) OVER ()) * {float(BLOCKS)}::DOUBLE)) ELSE 0 END::BIGINT AS quota FROM t0),
h0 AS (SELECT source, unnest(range(quota)) AS nth, 0 AS first, {shards} AS k FROM t),{"".join(levels)}
c AS (
  SELECT d.*, t.source_size, t.target, t.quota, row_number() OVER () AS uid,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY perm, doc_id, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS ({copies}),
o AS (
  SELECT e.*, {last}.first AS shard
  FROM e LEFT JOIN {last} ON e.source IS NOT DISTINCT FROM {last}.source AND e.size > 0 AND middle < target AND {last}.nth = least(floor(middle / (target / quota)), quota - 1))
SELECT doc_id, size, source_size, target, (size * count(shard))::BIGINT AS taken, coalesce(string_agg(shard::VARCHAR, ',' ORDER BY repeat) FILTER (shard IS NOT NULL), '') AS shards
FROM o GROUP BY uid, doc_id, size, source_size, target
"""


ORACLE = _oracle()
