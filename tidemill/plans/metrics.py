"""Metric compiler: simple, ratio, derived, cumulative and saved-query metrics as DataFrames, or a refusal.

A metric that cannot be compiled faithfully is refused with a reason, never approximated.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "avg": F.avg, "average": F.avg, "count": F.count, "count_distinct": F.countDistinct, "min": F.min, "max": F.max,
}
ADDITIVE = ("sum", "count")
GRAINS = ("day", "week", "month", "quarter", "year")
_TEMPLATE = re.compile(r"\{\{\s*Dimension\s*\(\s*['\"](\w+?)__(\w+)['\"]\s*\)\s*\}\}")


class Unsupported(ValueError):
    """Why a metric is not compiled."""


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str
    expr: str


@dataclass(frozen=True)
class Model:
    """A semantic model over one frame: its entities map names to key columns, the first is its own (primary) one."""

    name: str
    frame: DataFrame
    entities: dict[str, str]
    time: str | None
    measures: tuple[Measure, ...] = ()
    dimensions: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Metric:
    name: str
    kind: str = "simple"
    measure: str | None = None
    filter: str | None = None
    fill: float | None = None
    spine: bool = False
    numerator: str | None = None
    denominator: str | None = None
    expr: str | None = None
    inputs: tuple[tuple[str, str, str | None], ...] = ()  # metric, alias, offset such as "1 month"
    window: int | None = None
    grain_to_date: str | None = None
    numerator_offset: str | None = None
    denominator_offset: str | None = None
    offset_to_grain: str | None = None


class Compiler:
    def __init__(self, models: list[Model], metrics: list[Metric]):
        self.models, self.metrics = models, {m.name: m for m in metrics}
        self.skipped: dict[str, str] = {}

    def _measure(self, name: str) -> tuple[Model, Measure]:
        for m in self.models:
            for x in m.measures:
                if x.name == name:
                    if x.agg not in AGGREGATES:
                        raise Unsupported(f"aggregate {x.agg}")
                    return m, x
        raise Unsupported(f"measure {name}")

    def _resolve(self, model: Model, entity: str, dim: str) -> tuple[str, Model | None]:
        """The dimension's expression, and the model to join (by its primary entity) if it is another one."""
        if entity in model.entities and entity == next(iter(model.entities)) and dim in model.dimensions:
            return model.dimensions[dim], None
        for m in self.models:
            if next(iter(m.entities)) == entity and dim in m.dimensions and entity in model.entities:
                return m.dimensions[dim], m
        raise Unsupported(f"dimension {entity}__{dim}")

    def _base(self, model: Model, filters: list[str], dims: list[str]) -> tuple[DataFrame, list[str]]:
        """The model's rows with the dimensions that are asked for, and the filters over them."""
        frame, joined, conditions = model.frame, set(), []

        def column(entity: str, dim: str) -> str:
            nonlocal frame
            expr, other = self._resolve(model, entity, dim)
            name = f"{entity}__{dim}"
            if name not in joined:
                joined.add(name)
                if other is None:
                    frame = frame.withColumn(name, F.expr(expr))
                else:  # left join through the shared entity: rows without a match stay
                    right = other.frame.select(F.col(other.entities[entity]).alias("_k"), F.expr(expr).alias(name))
                    frame = frame.join(right, frame[model.entities[entity]] == right["_k"], "left").drop("_k")
            return name

        for d in dims:
            column(*d.split("__"))
        for f in filters:
            frame_filter = _TEMPLATE.sub(lambda m: f"`{column(m[1], m[2])}`", f)
            if "{{" in frame_filter:
                raise Unsupported(f"filter {f}")
            conditions.append(frame_filter)
        return frame, conditions

    def simple(self, metric: Metric, grain: str, dims: tuple[str, ...] = (), where: tuple[str, ...] = ()) -> DataFrame:
        """``metric_time``, dimensions and the value."""
        return self._filled(self._aggregated([metric], grain, dims, where), metric, grain, dims)

    def _aggregated(self, metrics: list[Metric], grain: str, dims: tuple[str, ...], where: tuple[str, ...]) -> DataFrame:
        """Simple metrics over one model by time and dimensions, in one pass.

        Where filters differ, each is the condition of its aggregate, and ``_has_`` and the name say whether a group has
        rows of the metric; rows that no metric wants are filtered out before.
        """
        if grain not in GRAINS:
            raise Unsupported(f"grain {grain}")
        for m in metrics:
            if m.kind != "simple":
                raise Unsupported(f"{m.name} is {m.kind}")
        found = [self._measure(m.measure) for m in metrics]
        model = found[0][0]
        own = [m.filter for m in metrics]
        differ = len(set(own)) > 1
        frame, conditions = self._base(model, [f for f in (*where, *own) if f], list(dims))
        mine = iter(conditions[len(where) :])
        of = [F.expr(next(mine)) if f else F.lit(True) for f in own]
        for c in conditions[: len(where)]:
            frame = frame.where(c)
        frame = frame.where(reduce(lambda a, b: a | b, of))
        out = []
        for metric, (_, measure), condition in zip(metrics, found, of, strict=True):
            value = F.expr(measure.expr)
            value = money(value) if measure.agg == "sum" else value
            out.append(AGGREGATES[measure.agg](F.when(condition, value) if differ else value).alias(metric.name))
            if differ:
                out.append((F.count_if(condition) > 0).alias(f"_has_{metric.name}"))
        return frame.groupBy(F.to_date(F.date_trunc(grain, F.col(model.time))).alias("metric_time"), *dims).agg(*out)

    def _together(self, metrics: list[Metric]) -> bool:
        """Whether one pass serves them: different simple metrics over one model."""
        return all(m.kind == "simple" for m in metrics) and len({m.name for m in metrics}) == len(metrics) and len({self._measure(m.measure)[0].name for m in metrics}) == 1

    @staticmethod
    def _filled(out: DataFrame, metric: Metric, grain: str, dims: tuple[str, ...]) -> DataFrame:
        if metric.spine and not dims:
            spine = out.agg(F.min("metric_time").alias("lo"), F.max("metric_time").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr(f"interval 1 {grain}"))).alias("metric_time"))
            out = spine.join(out, "metric_time", "left")
            if metric.fill is not None:
                out = out.withColumn(metric.name, F.coalesce(metric.name, F.lit(metric.fill).cast(out.schema[metric.name].dataType)))
        return out

    def ratio(self, metric: Metric, grain: str, dims: tuple[str, ...] = (), where: tuple[str, ...] = ()) -> DataFrame:
        """The denominator drives; a missing numerator is 0; a denominator of 0 gives null."""
        if metric.numerator_offset or metric.denominator_offset:
            raise Unsupported("offset of a ratio's leg")
        top, bottom = self.metrics[metric.numerator], self.metrics[metric.denominator]
        if self._together([top, bottom]) and (dims or not top.spine or not top.fill):
            out = self._aggregated([bottom, top], grain, dims, where)
            if f"_has_{bottom.name}" in out.columns:
                out = out.where(F.col(f"_has_{bottom.name}"))
            out = self._filled(out, bottom, grain, dims)
            value = F.coalesce(F.col(top.name).cast("double"), F.lit(0.0)) / F.nullif(F.col(bottom.name).cast("double"), F.lit(0.0))
            return out.select("metric_time", *dims, value.alias(metric.name))
        n, d = self.simple(top, grain, dims, where), self.simple(bottom, grain, dims, where)
        keys = ["metric_time", *dims]
        n = n.select(*[F.col(k).alias(f"n_{k}") for k in keys], F.col(top.name).alias("_n"))
        on = reduce(lambda a, b: a & b, [d[k].eqNullSafe(n[f"n_{k}"]) for k in keys])
        value = F.coalesce(F.col("_n").cast("double"), F.lit(0.0)) / F.nullif(F.col(bottom.name).cast("double"), F.lit(0.0))
        return d.join(n, on, "left").select(*keys, value.alias(metric.name))

    def derived(self, metric: Metric) -> DataFrame:
        """Inputs at the offset's grain; an offset leg is shifted forward and joined by time, to the first input."""
        if metric.offset_to_grain:
            raise Unsupported("offset_to_grain")
        offsets = {o for _, _, o in metric.inputs if o}
        units = {o.split()[1].rstrip("s") for o in offsets}
        if len(units) > 1:
            raise Unsupported("offsets of different grains")
        grain = units.pop() if units else "day"
        if grain not in GRAINS:
            raise Unsupported(f"grain {grain}")
        legs = []
        for name, alias, offset in metric.inputs:
            leg = self.simple(self.metrics[name], grain).withColumnRenamed(name, alias)
            if offset:
                leg = leg.withColumn("metric_time", F.to_date(F.col("metric_time") + F.expr(f"interval {offset}")))
            legs.append(leg)
        joined = reduce(lambda a, b: a.join(b, "metric_time", "left"), legs)
        return joined.select("metric_time", F.expr(metric.expr).alias(metric.name))

    def cumulative(self, metric: Metric) -> DataFrame:
        """Trailing days, or to-date within a grain, for every day of the observed range, by a window over the filled series."""
        if (metric.window is None) == (metric.grain_to_date is None):
            raise Unsupported("exactly one of window and grain_to_date")
        model, measure = self._measure(metric.measure)
        if measure.agg not in ADDITIVE:
            raise Unsupported(f"cumulative {measure.agg}")
        daily = self.simple(Metric(metric.name, measure=metric.measure, filter=metric.filter, fill=0, spine=True), "day")
        part = F.date_trunc(metric.grain_to_date, "metric_time") if metric.grain_to_date else F.lit(0)
        order = Window.partitionBy(part).orderBy(F.unix_date("metric_time"))
        frame = order.rangeBetween(-(metric.window - 1), 0) if metric.window else order.rangeBetween(Window.unboundedPreceding, 0)
        return daily.withColumn(metric.name, F.sum(metric.name).over(frame))

    def saved(self, names: list[str], grain: str, dims: tuple[str, ...], where: tuple[str, ...] = ()) -> DataFrame:
        """Metrics side by side; the first drives, keys compare null-safe, ``where`` applies to each."""
        metrics, keys = [self.metrics[n] for n in names], ["metric_time", *dims]
        if self._together(metrics) and (dims or not any(m.spine for m in metrics)):
            out = self._aggregated(metrics, grain, dims, where)
            if f"_has_{names[0]}" not in out.columns:
                return out
            return out.where(F.col(f"_has_{names[0]}")).select(*keys, *[F.when(F.col(f"_has_{n}"), F.col(n)).alias(n) for n in names])
        frames = [self.build(n, grain, dims, where) for n in names]
        out = frames[0]
        for f in frames[1:]:
            r = f.select(*[F.col(k).alias(f"r_{k}") for k in keys], f.columns[-1])
            out = out.join(r, reduce(lambda a, b: a & b, [out[k].eqNullSafe(r[f"r_{k}"]) for k in keys]), "left").drop(*[f"r_{k}" for k in keys])
        return out

    def build(self, name: str, grain: str = "day", dims: tuple[str, ...] = (), where: tuple[str, ...] = ()) -> DataFrame:
        metric = self.metrics[name]
        if metric.kind == "simple":
            return self.simple(metric, grain, dims, where)
        if metric.kind == "ratio":
            return self.ratio(metric, grain, dims, where)
        if dims or where:
            raise Unsupported(f"{metric.kind} with dimensions")
        if metric.kind == "derived":
            return self.derived(metric)
        if metric.kind == "cumulative":
            return self.cumulative(metric)
        raise Unsupported(f"kind {metric.kind}")

    def build_all(self, grain: str = "day") -> dict[str, DataFrame]:
        """What compiles; the rest is in ``skipped`` with its reason."""
        out = {}
        for name in self.metrics:
            try:
                out[name] = self.build(name, grain)
            except Unsupported as e:
                self.skipped[name] = str(e)
        return out
