"""Sharding by size-tiered compaction. DataFrame operations and the file system's own rename only.

A table is a folder of immutable runs and of manifests ``v00000001.json``, ``v00000002.json``, ... Each manifest lists
the live runs with their sizes. An arrival is appended as a run of small files; runs of one size tier (sizes
within a factor of ``fanout``) are merged, ``fanout`` or more at a time, into files of about ``target_bytes``. A commit
writes a new manifest to a hidden name and renames it, which fails if that version exists: readers see the old table or
the new, and of two writers one tries again on the version that the other made. Runs that no kept manifest needs, and
those of writers that never committed, are removed by :meth:`ShardTable.vacuum`.

This needs a rename that fails where the target exists: HDFS and local disks have it, plain object stores do not.

Scale: a merge reads its runs and coalesces neighbouring splits, without a shuffle, so that a file is the target's size
give or take one split; each byte is rewritten once for each tier, that is log_fanout(size) times.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Run:
    name: str
    bytes: int
    tier: int
    files: int


class ShardTable:
    """A versioned table of shards at ``path``, on a file system whose rename does not replace a file."""

    def __init__(self, spark: SparkSession, path: str, schema, target_bytes: int = 128 << 20, fanout: int = 4, smallest: int = 1 << 20):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.target_bytes, self.fanout, self.smallest = target_bytes, fanout, smallest

    # -- file system
    def _at(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _run(self, name: str) -> Run:
        p, fs = self._at("runs", name)
        summary = fs.getContentSummary(p)
        size = summary.getLength()
        return Run(name, size, max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout))), sum(1 for s in fs.globStatus(self._at("runs", name, "*.parquet")[0]) or []))

    def versions(self) -> list[int]:
        found, fs = self._at("manifests", "v*.json")
        return sorted(int(s.getPath().getName()[1:-5]) for s in fs.globStatus(found) or [])

    def manifest(self, version: int | None = None) -> tuple[int, list[Run]]:
        """The version, the newest if none is named, and its runs. An empty table has version 0."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return 0, []
        text = self.spark.read.text(str(self._at("manifests", f"v{version:08d}.json")[0]), wholetext=True).first()[0]
        return version, [Run(**r) for r in json.loads(text)["runs"]]

    def commit(self, base: int, runs: list[Run]) -> int:
        """Makes ``runs`` the version after ``base``, or raises :class:`CommitConflict`."""
        target, fs = self._at("manifests", f"v{base + 1:08d}.json")
        hidden, _ = self._at("manifests", f"_{uuid.uuid4().hex}.tmp")
        out = fs.create(hidden, False)
        out.write(bytearray(json.dumps({"version": base + 1, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(hidden, target):
            fs.delete(hidden, False)
            raise CommitConflict(f"version {base + 1} exists")
        return base + 1

    def change(self, make) -> int:
        """Commits ``make(runs)``, again and again on what other writers have committed, until it is the next version or None."""
        while True:
            version, runs = self.manifest()
            new = make(runs)
            if new is None:
                return version
            try:
                return self.commit(version, new)
            except CommitConflict:
                continue

    # -- operations
    def write_runs(self, arrivals: DataFrame, by: str | None = None) -> list[Run]:
        """Rows as one run, or as one run for each value of ``by`` in a single pass, that no manifest lists yet."""
        label = uuid.uuid4().hex
        p, fs = self._at("runs", label)
        writer = arrivals.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(str(p))
        names = sorted(f"{label}/{s.getPath().getName()}" for s in fs.globStatus(self._at("runs", label, f"{by}=*")[0]) or []) if by else [label]
        return [self._run(n) for n in names]

    def append(self, arrivals: DataFrame) -> int:
        """Adds rows as one run."""
        new = self.write_runs(arrivals)
        return self.change(lambda runs: runs + new)

    def due(self, runs: list[Run]) -> list[Run]:
        """The runs of the lowest tier that holds ``fanout`` or more."""
        for tier in sorted({r.tier for r in runs}):
            if len(same := [r for r in runs if r.tier == tier]) >= self.fanout:
                return sorted(same, key=lambda r: (r.bytes, r.name))
        return []

    def compact(self) -> int:
        """Merges until no tier holds ``fanout`` runs; returns the version. A merge whose runs another writer has merged is given up."""
        while merge := self.due(self.manifest()[1]):
            name = uuid.uuid4().hex
            files = max(1, round(sum(r.bytes for r in merge) / self.target_bytes))
            self._read(merge).coalesce(files).write.option("compression", "zstd").parquet(str(self._at("runs", name)[0]))
            gone, new = {r.name for r in merge}, self._run(name)
            self.change(lambda runs: [r for r in runs if r.name not in gone] + [new] if gone <= {r.name for r in runs} else None)
        return self.manifest()[0]

    def vacuum(self, keep_versions: int = 2, grace_seconds: float = 3600.0) -> int:
        """Deletes the older manifests, and the runs that none of the newest lists; returns how many runs.

        Runs younger than ``grace_seconds`` stay, as their writer may be about to commit, or a reader of an older version
        may still be reading.
        """
        kept = self.versions()[-keep_versions:]
        live = {r.name for v in kept for r in self.manifest(v)[1]}
        for v in self.versions()[:-keep_versions]:
            p, fs = self._at("manifests", f"v{v:08d}.json")
            fs.delete(p, False)
        everything, fs = self._at("runs", "*")
        oldest, gone = (time.time() - grace_seconds) * 1000, 0
        for top in fs.globStatus(everything) or []:
            label = top.getPath().getName()
            inner = [s for s in fs.listStatus(top.getPath()) if s.isDirectory() and "=" in s.getPath().getName()]
            for s in inner or [top]:
                name = f"{label}/{s.getPath().getName()}" if inner else label
                if name not in live and s.getModificationTime() <= oldest:
                    fs.delete(s.getPath(), True)
                    gone += 1
            if inner and not any(n.startswith(label + "/") for n in live) and top.getModificationTime() <= oldest:
                fs.delete(top.getPath(), True)
        return gone

    def _read(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[str(self._at("runs", r.name)[0]) for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version)[1])


def shard_documents(docs: DataFrame, path: str, arrivals: int = 8, target_bytes: int = 32 << 20, fanout: int = 4) -> ShardTable:
    """``docs`` as ``arrivals`` arrivals, each a version of its own and compacted as tiers fill; the table holds every row once.

    The input is read once: a single pass writes the runs of all arrivals, which are then committed one by one. Runs that
    were merged away go at the end, as nobody else has read this new table.

    Null ids, texts and sources are kept as they are; repeated rows stay repeated; an empty table gives a table
    without rows. Column names must differ, as in any Parquet table; an input column called ``arrival_`` is kept.
    """
    table = ShardTable(docs.sparkSession, path, docs.schema, target_bytes, fanout)
    mark = "arrival_"
    while mark in docs.columns:
        mark += "_"
    dealt = docs.withColumn(mark, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map" not in t]), F.lit(arrivals)))
    for run in table.write_runs(dealt, by=mark):
        table.change(lambda runs, new=run: runs + [new])
        table.compact()
    table.vacuum(keep_versions=1, grace_seconds=0.0)
    return table


ORACLE = "SELECT doc_id, source, lang, n_chars, md5(text) AS text_md5 FROM documents"
