"""Joins, windows and set operations that take more than one built-in call."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, tie: str, span: str | None = None) -> DataFrame:
    """``left`` with the ``value`` of the latest ``right`` row of its key at or before its time; null if none.

    Both sides are sorted once by (key, time) and swept, so a key with many rows on both sides never forms pairs. With
    ``span`` (such as "month") a key's rows are swept in spans of time, by as many tasks, and the last value of each span
    is carried into the next ones: a key that holds most rows does not meet in one task. Null keys and times match nothing.
    """
    types = {c: right.schema[c].dataType for c in (value, tie)}
    nothing = [F.lit(None).cast(types[c]).alias(n) for c, n in ((value, "_v"), (tie, "_tie"))]
    l = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(False).alias("_has"), *nothing)
    r = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    r = r.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(True).alias("_has"), F.col(value).alias("_v"), F.col(tie).alias("_tie"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_span", F.date_trunc(span, "_t") if span else F.lit(0))
    sweep = Window.partitionBy(key, *["_span"] * bool(span)).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last(F.when(F.col("_has"), F.struct("_v")), ignorenulls=True).over(sweep)).where("_side = 1")
    if span:
        # One row for each key and span, also for those that have left rows only.
        ends = both.groupBy(key, "_span").agg(F.max(F.when(F.col("_has"), F.struct("_t", "_tie", F.struct("_v").alias("_end")))).alias("_max"))
        before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(F.col(key).alias("_key"), F.col("_span").alias("_of"), F.last("_max._end", ignorenulls=True).over(before).alias("_carried"))
        found = found.join(carried, (F.col(key) == F.col("_key")) & (F.col("_span") == F.col("_of")), "left")
        found = found.withColumn("_last", F.coalesce("_last", "_carried")).drop("_key", "_of", "_carried")
    return found.withColumn(f"last_{value}", F.col("_last._v")).drop("_t", "_side", "_v", "_has", "_tie", "_last", "_span")


def range_lookup(facts: DataFrame, periods: DataFrame, date: Column, start: str, end: str, on: Column | None = None, step: str = "month") -> DataFrame:
    """Left join of facts with the period that holds their date.

    Each period is repeated for the ``step`` intervals that it touches, and facts meet those of their date's interval by an
    equal key: a hash or sort-merge join, never a nested loop. A fact's date lies in one interval, so it meets a period once.
    """
    each = F.explode(F.sequence(F.trunc(F.col(start).cast("date"), step), F.trunc(F.col(end).cast("date"), step), F.expr(f"interval 1 {step}")))
    touched = periods.where(F.col(start) <= F.col(end)).withColumn("_interval", each)
    same = (F.trunc(date.cast("date"), step) == F.col("_interval")) & date.between(F.col(start), F.col(end))
    return facts.join(touched, same if on is None else on & same, "left").drop("_interval")


def not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``column NOT IN (values)``, ``values`` being of one column: a null among them leaves no row, without values all stay.

    An equal-key anti join; what nulls decide is one row, so nothing that grows is broadcast.
    """
    seen = values.select(F.col(values.columns[0]).alias("_value"))
    nulls = seen.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_value").isNull()).alias("_nulls"))
    left = df.join(seen.distinct(), F.col(column) == F.col("_value"), "left_anti").crossJoin(F.broadcast(nulls))
    return left.where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())).drop("_n", "_nulls")


def point_in_time(facts: DataFrame, history: DataFrame, key: str, at: str) -> DataFrame:
    """Left join with the version of the key that was valid then: from ``valid_from``, before ``valid_to`` (null: open)."""
    h = history.withColumnRenamed(key, "_key")
    return facts.join(h, (facts[key] == h["_key"]) & (F.col(at) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to"))), "left").drop("_key")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name of frames with equal columns and types; any drift raises."""
    frames = list(frames)
    want = dict(frames[0].dtypes)
    for f in frames[1:]:
        if dict(f.dtypes) != want:
            raise ValueError(f"columns differ: {sorted(set(f.dtypes) ^ set(frames[0].dtypes))}")
    return reduce(DataFrame.unionByName, frames)


def override(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``base`` that ``other`` has no row for, and the rows of ``other``."""
    return base.join(other.select(*keys).distinct(), keys, "left_anti").unionByName(other)


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key. The order should end in a unique column."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_counted(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows and, in each, how many were ``dropped``. The order should end in a unique column."""
    n = df.agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("dropped"))
    return df.orderBy(*order).limit(k).crossJoin(F.broadcast(n))


def full_outer(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of several frames on coalesced keys; null keys match each other."""
    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        r = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in keys])
        on = reduce(lambda x, y: x & y, [a[k].eqNullSafe(r[f"_{k}"]) for k in keys])
        return a.join(r, on, "full").select(*[F.coalesce(a[k], r[f"_{k}"]).alias(k) for k in keys], *[a[c] for c in a.columns if c not in keys], *[r[c] for c in b.columns if c not in keys])

    return reduce(two, frames)


def year_counter(years: DataFrame, start: str, end: str, as_of) -> DataFrame:
    """``FyCounter``: 0 for the year that holds ``as_of``, -1, -2, ... before it and 1, 2, ... after it."""
    now = F.lit(as_of)
    past, future = F.col(end) < now, F.col(start) > now
    back = F.row_number().over(Window.partitionBy(past).orderBy(F.col(start).desc()))
    ahead = F.row_number().over(Window.partitionBy(future).orderBy(F.col(start)))
    return years.withColumn("FyCounter", F.when(past, -back).when(future, ahead).otherwise(F.lit(0)))


def dense_grid(df: DataFrame, key: str, day: str) -> DataFrame:
    """Every key with every month from the first to the last of the data."""
    span = df.agg(F.min(F.trunc(day, "month")).alias("lo"), F.max(F.trunc(day, "month")).alias("hi"))
    months = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    return df.select(key).distinct().crossJoin(months)
