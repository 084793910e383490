"""Sources and sinks: seeds, catalog probes, incremental upserts, snapshots, text tables."""

from __future__ import annotations

import json
import re
import uuid
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keep_first


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def empty_clone(df: DataFrame) -> DataFrame:
    return df.limit(0)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class Conflict(RuntimeError):
    """Another writer published the next version first."""


class VersionedTable:
    """A Parquet table of numbered versions: a writer makes a new folder, then a manifest ``m00000001`` that names it.

    A manifest is written under a hidden name and renamed, which fails if that version exists; none is ever replaced or
    removed by a writer, so a reader sees the old rows or the new, also after a crash, and of two writers one gets
    :class:`Conflict` and works on the other's rows. This needs a rename that does not replace a file. ``protected``
    refuses to be replaced; a schema change may add columns only. An upsert rewrites the table.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], partition_by: tuple[str, ...] = (), protected: bool = False):
        self.spark, self.path, self.keys, self.partition_by, self.protected = spark, path.rstrip("/"), keys, partition_by, protected

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        p, fs = _path(self.spark, f"{self.path}/m*")
        return max((int(s.getPath().getName()[1:]) for s in fs.globStatus(p) or []), default=0)

    def current(self, version: int | None = None) -> DataFrame | None:
        version = version or self.version()
        return self.spark.read.parquet(f"{self.path}/{self.spark.read.text(f'{self.path}/m{version:08d}').first()[0]}") if version else None

    def _publish(self, df: DataFrame, base: int) -> None:
        name = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*self.partition_by).parquet(f"{self.path}/{name}")
        hidden, fs = _path(self.spark, f"{self.path}/_{name}")
        out = fs.create(hidden, False)
        out.write(bytearray(name.encode()))
        out.close()
        target, _ = _path(self.spark, f"{self.path}/m{base + 1:08d}")
        if fs.exists(target) or not fs.rename(hidden, target):
            fs.delete(hidden, False)
            fs.delete(_path(self.spark, f"{self.path}/{name}")[0], True)
            raise Conflict(f"{self.path}: version {base + 1} exists")

    def replace(self, df: DataFrame) -> None:
        base = self.version()
        if self.protected and base:
            raise PermissionError(f"{self.path} is never fully refreshed")
        self._publish(df, base)

    def upsert(self, batch: DataFrame, order_by: str | None = None, attempts: int = 5) -> None:
        """Rows of the batch take the place of those with their keys (null keys match each other); new columns are null in old rows.

        Of several rows of a key the last by ``order_by`` goes in; without an order they are refused. Where another writer
        comes first the upsert is made again on its version.
        """
        if order_by:
            batch = keep_first(batch, self.keys, F.desc(order_by), *[F.col(c) for c in batch.columns])
        elif not batch.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError(f"the batch has several rows of a key of {self.path}")
        for left in reversed(range(attempts)):
            base = self.version()
            old = self.current(base)
            if old is not None and (gone := set(old.columns) - set(batch.columns)):
                raise ValueError(f"the batch lacks {sorted(gone)}")
            new = batch
            if old is not None:
                there = batch.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
                same = reduce(lambda a, b: a & b, [old[k].eqNullSafe(there[f"_{k}"]) for k in self.keys])
                new = old.join(there, same, "left_anti").unionByName(batch, allowMissingColumns=True)
            try:
                return self._publish(new, base)
            except Conflict:
                if not left:
                    raise

    def since(self, column: str, lookback: timedelta):
        """The value from which an incremental run reads again, as a literal so that scans can prune by it; None at first."""
        old = self.current()
        last = old.agg(F.max(column)).first()[0] if old is not None else None
        return last - lookback if last is not None else None


def snapshot(history: DataFrame | None, current: DataFrame, key: str, check: list[str], now: Column) -> DataFrame:
    """The next state of a type-2 history with ``valid_from``, ``valid_to`` and ``is_deleted``.

    A key with another value in a checked column gets a new version; a key that is gone gets a version that says so; one
    that comes back gets a new version.
    """
    fresh = current.withColumn("is_deleted", F.lit(False)).withColumn("valid_from", now).withColumn("valid_to", F.lit(None).cast("timestamp"))
    if history is None:
        return fresh
    columns = fresh.columns
    closed, open_ = history.where("valid_to is not null"), history.where("valid_to is null")
    seen = current.select(F.col(key).alias("_k"), F.struct(*check).alias("_new"))
    both = open_.join(seen, open_[key] == seen["_k"], "left")
    same = F.col("_k").isNotNull() & F.struct(*check).eqNullSafe(F.col("_new")) & ~F.col("is_deleted")
    stays = same | (F.col("_k").isNull() & F.col("is_deleted"))
    kept = both.withColumn("valid_to", F.when(~stays, now)).select(*columns)
    gone = both.where(F.col("_k").isNull() & ~F.col("is_deleted")).withColumn("is_deleted", F.lit(True)).withColumn("valid_from", now).withColumn("valid_to", F.lit(None).cast("timestamp")).select(*columns)
    unchanged = both.where(same).select(open_[key])
    new = fresh.join(unchanged, key, "left_anti").select(*columns)
    return closed.select(*columns).unionByName(kept).unionByName(gone).unionByName(new)


def latest_timestamp(frames: list[tuple[DataFrame, str]], spark: SparkSession) -> DataFrame:
    """The largest of several tables' columns; one null row without tables."""
    out = spark.range(1).select(F.lit(None).cast("timestamp").alias("at"))
    for df, c in frames:
        out = out.unionByName(df.agg(F.max(c).cast("timestamp").alias("at")))
    return out.agg(F.max("at").alias("latest"))


def table_metadata(df: DataFrame, name: str, org: str, synced: str) -> DataFrame:
    """Rows and last sync by org; an empty table gives one row with 0."""
    by = df.groupBy(F.col(org).cast("string").alias("org")).agg(F.max(synced).alias("last_sync"), F.count(F.lit(1)).alias("n_rows"))
    none = df.agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows = 0").select(F.lit(None).cast("string").alias("org"), F.lit(None).cast(by.schema["last_sync"].dataType).alias("last_sync"), "n_rows")
    return by.unionByName(none).select(F.lit(name).alias("table_name"), "org", "last_sync", "n_rows")


def publish(df: DataFrame, alias: str, materialized: str | None = None) -> str:
    """The frame under an alias: as a view, or as a table of its rows at a path. Returns the alias."""
    if materialized:
        df.write.option("path", materialized).saveAsTable(alias)
    else:
        df.createOrReplaceTempView(alias)
    return alias


def stale_tables(spark: SparkSession, database: str, expected: set[str], dry_run: bool = True) -> list[str]:
    """Tables that no model makes any more; dropped only if asked to."""
    gone = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary and t.name not in expected)
    for t in [] if dry_run else gone:
        spark.sql(f"DROP TABLE `{database}`.`{t}`")
    return gone


def schema_name(custom: str | None, target: str, default: str, verbatim: tuple[str, ...] = ("prod",), prod: str = "analytics") -> str:
    """The custom name as it is for the targets that may use it, behind the default elsewhere, never the production one."""
    out = default if not custom else custom if target in verbatim else f"{default}_{custom}"
    if target not in verbatim and out == prod:
        raise PermissionError(f"{target} would write to {prod}")
    return out


_BARE = re.compile(r"[A-Za-z_][\w .-]*").fullmatch


def _cell(v) -> str:
    if v is None or isinstance(v, (bool, int, float)):
        return json.dumps(v)
    text = str(v)
    return text if _BARE(text) and text == text.strip() and text not in ("null", "true", "false") else json.dumps(text, ensure_ascii=False)


def to_toon(name: str, df: DataFrame) -> str:
    """Rows as a table in text: a header with their number and fields, then a line each. For small results: it streams to the driver."""
    lines = [",".join(_cell(v) for v in r) for r in df.toLocalIterator()]
    return "\n".join([f"{name}[{len(lines)}]{{{','.join(df.columns)}}}:", *[f"  {x}" for x in lines]])


def from_toon(text: str) -> tuple[str, list[dict]]:
    head, *lines = text.split("\n")
    m = re.fullmatch(r"(\w+)\[(\d+)\]\{(.*)\}:", head)
    if not m or int(m[2]) != len(lines):
        raise ValueError("not a table")
    cell = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[^,]*)(?:,|$)')

    def parse(line: str) -> list:
        found, at = [], 0
        fields = len(m[3].split(","))
        for _ in range(fields):
            c = cell.match(line, at)
            at, raw = c.end(), c[1].strip()
            try:
                found.append(json.loads(raw))
            except ValueError:
                found.append(raw)
        return found

    return m[1], [dict(zip(m[3].split(","), parse(x.strip()), strict=True)) for x in lines]
