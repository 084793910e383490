"""Model registry, connector registry and conformed unions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import union_all
from .graph import order


@dataclass
class Project:
    """Models as functions of the frames they read; materialized as lazy frame, view or table."""

    spark: SparkSession
    sources: Callable[[str], DataFrame]
    models: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], str]] = field(default_factory=dict)

    def model(self, *parents: str, name: str | None = None, materialized: str = "ephemeral"):
        def add(f):
            self.models[name or f.__name__] = (f, parents, materialized)
            return f

        return add

    def closure(self, target: str) -> list[str]:
        """The target and all it needs, parents first; sources that nothing needs are never loaded."""
        need, todo = set(), [target]
        while todo:
            if (n := todo.pop()) not in need:
                need.add(n)
                todo += self.models[n][1] if n in self.models else ()
        return [n for n in order({n: list(self.models[n][1]) if n in self.models else [] for n in need})]

    def build(self, target: str) -> DataFrame:
        frames: dict[str, DataFrame] = {}
        for n in self.closure(target):
            if n not in self.models:
                frames[n] = self.sources(n)
                continue
            f, parents, how = self.models[n]
            frames[n] = f(*[frames[p] for p in parents])
            if how == "view":
                frames[n].createOrReplaceTempView(n)
            elif how == "table":
                frames[n].write.mode("overwrite").saveAsTable(n)
                frames[n] = self.spark.table(n)
        return frames[target]


@dataclass(frozen=True)
class Connector:
    name: str
    default_currency: str
    enabled: bool = True
    models: tuple[str, ...] = ()


def conform(df: DataFrame, connector: Connector, ids: tuple[str, ...], exceptions: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``DataSource``, ``DefaultCurrency`` and, for each id, ``<id>ERP``: the id with the source behind it."""
    suffix = f"-ds_{connector.name.lower().replace(' ', '_')}"
    keys = [F.concat(F.col(i).cast("string"), F.lit("" if i in exceptions else suffix)).alias(f"{i}ERP") for i in ids]
    return df.select("*", F.lit(connector.name).alias("DataSource"), F.lit(connector.default_currency).alias("DefaultCurrency"), *keys)


def conformed_union(concept: str, connectors: list[Connector], adapters: dict[str, Callable[[], DataFrame]], ids: tuple[str, ...]) -> DataFrame:
    """Union over the enabled connectors that list the concept, in registry order; one without an adapter raises."""
    chosen = [c for c in connectors if c.enabled and concept in c.models]
    if missing := [c.name for c in chosen if c.name not in adapters]:
        raise LookupError(f"{concept}: no adapter for {', '.join(missing)}")
    return union_all([conform(adapters[c.name](), c, ids) for c in chosen])
