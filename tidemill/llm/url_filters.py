"""URL filters: a sort-merge range join of pages with nested prefix rules. DataFrame operations only.

A host's canonical key is its labels in reverse, each followed by a dot (``www.example.com`` is ``com.example.www.``),
so that a rule's host and all its subdomains are one interval of keys, ``[com.example., com.example/)``, as ``/`` is
the character after the dot. Intervals of two rules are nested or disjoint. Rule boundaries carry the stack of rules that
are active from there on; pages and boundaries are sorted by key in one sweep, each page reads the last stack before
it, and of that stack the rules whose path the page's path starts with remain. The longest host, then the longest path
wins.

Scale: pages and boundaries are range-partitioned once by key, each boundary once, however many partitions there are;
pages with one key are spread by a hash of theirs, so a host with a third of all pages spans many ranges. A range starts
with the last stack of the ranges before it: one row a range. Nothing is broadcast by hint or collected, and no rule
meets a page outside its stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import at_least, estimated_bytes, written

#: The rules of the query: (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: The verdict of a page that no rule fits.
DEFAULT_VERDICT = "allow"
#: Bytes of pages, as estimated from what is read, for each range.
RANGE_BYTES = 16 << 20
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(_labels(host), "."), F.lit("."))


def rule_boundaries(rules: DataFrame) -> DataFrame:
    """``key``, ``stack``: from this key on, up to the next, these rules are active.

    A rule with a null host, path or verdict is ignored; equal rules count once.
    """
    rules = rules.select("host", "path", "verdict").dropna().distinct().withColumn("key", host_key(F.col("host")))
    rule = F.struct(
        F.length("key").alias("host_length"), F.length("path").alias("path_length"), F.concat("host", "path").alias("rule"), "verdict", "path"
    )
    by_host = rules.groupBy("key").agg(F.collect_list(rule).alias("own"))
    # The rule hosts above a rule host are prefixes of its labels: an equi-join, not a range join.
    labels = F.filter(F.split("key", r"\."), lambda x: x != "")
    above = by_host.select(F.col("key").alias("below"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels))), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))).alias("key"))
    nested = above.join(by_host, "key").groupBy("below").agg(F.flatten(F.collect_list("own")).alias("stack"), F.max(F.when(F.col("key") != F.col("below"), F.length("key"))).alias("parent_length"))
    starts = nested.select(F.col("below").alias("key"), "stack")
    ends = nested.select(
        F.concat(F.expr("substring(below, 1, length(below) - 1)"), F.lit("/")).alias("key"),
        F.expr("filter(stack, s -> s.host_length < length(below))").alias("stack"),
    )
    return starts.unionByName(ends)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` of every page.

    Null urls and urls without ``://`` have an empty host and path, which no rule fits. Repeated pages give repeated
    rows; an empty table gives none; other columns are not read, whatever their names.
    """
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    keys = [f"k{i}" for i in range(len(keep))]
    read = pages.select(*named, F.col(url).alias("u"))
    left = read.select(*keys, url_host(F.col("u")).alias("host"), url_path(F.col("u")).alias("path"), F.xxhash64(*keys, "u").alias("dice")).withColumn("key", host_key(F.col("host"))).withColumn("page", F.lit(True))
    right = rule_boundaries(rules).select("key", "stack", F.lit(False).alias("page"))
    both = left.unionByName(right, allowMissingColumns=True)
    parts = at_least(16, estimated_bytes(read), RANGE_BYTES)
    ranges = both.repartitionByRange(parts, "key", "page", "dice").withColumn("range", F.spark_partition_id())
    ranges = written(ranges, "url-ranges")
    # The last stack of each range, and of all before it.
    ends = ranges.where(~F.col("page")).groupBy("range").agg(F.max_by("stack", "key").alias("stack"))
    every = ranges.select("range").distinct().join(ends, "range", "left")
    carried = every.select("range", F.last("stack", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("range").orderBy("key", "page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranges.withColumn("own", F.last("stack", ignorenulls=True).over(sweep)).where("page")
    best = F.expr("array_max(filter(coalesce(own, carried), s -> startswith(path, s.path)))")
    return swept.join(written(carried, "url-carried"), "range").withColumn("best", best).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict")
    )


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])).alias("r")).select("r.*")


ORACLE = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(h, q, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
SELECT page_id, host, path,
       (SELECT arg_max(h || q, length(h) * 1000 + length(q)) FROM r WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q)) AS rule,
       coalesce((SELECT arg_max(v, length(h) * 1000 + length(q)) FROM r WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q)), 'allow') AS verdict
FROM p
"""
