"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 bits share a variant within one bit of each. For 3 bits half the radius is one
and a half, so the odd bit is taken out first: each fingerprint is seen three times, each time with another third of
its bits erased, and every view emits its variants within one bit. Of two fingerprints that differ in 3 bits some
third holds one of those bits at least; with it erased they differ in 2 bits or fewer, and meet. That is 131 variants a
fingerprint, where balls of one and of two bits would be 2,145.

Variants are dealt out by a hash to buckets as arrays of 9 bytes each (the fingerprint and which variant it is).
A bucket sorts its variants; fingerprints under one variant are verified against each other by a search that visits
each once, and the bucket keeps a spanning forest of the links it has verified, never all pairs of a group.

Scale: equal fingerprints are one node from the start, whatever their number; what one variant can hold is bounded by
the erased third and one bit (43 x 2^22 fingerprints), and the number of buckets grows with the number of fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import WORD, at_least, kept_by_worker, lean_batches, spread, written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: The erased thirds, as bit masks.
THIRDS = [(1 << 21) - 1, ((1 << 21) - 1) << 21, ((1 << 22) - 1) << 42]
VARIANT_BYTES = 9
BUCKET_BYTES = 2 << 20

_words = re.compile(WORD.encode()).findall
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: For each variant code: what to keep and what to flip.
_KEEP = np.array([(~m) & (2**64 - 1) for m in THIRDS for _ in range(1 + 64 - m.bit_count())], np.uint64)
_FLIP = np.array([f for m in THIRDS for f in [0, *(1 << i for i in range(64) if not m >> i & 1)]], np.uint64)
_VIEW = np.array([v for v, m in enumerate(THIRDS) for _ in range(1 + 64 - m.bit_count())], np.uint64)


def fingerprint(text: str | None) -> int:
    """A-Z in lower case, 3-word shingles joined by a blank, XXH64 with seed 42; a bit is set if over half have it."""
    words = _words((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((_BIT[2 * ones > len(h)]).sum(dtype=np.uint64))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_by_worker("simhash", bool)  # another operator's cache goes
    for batch in batches:
        f = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def variants(f: np.ndarray) -> np.ndarray:
    """Keys of all variants, a row for each fingerprint; the erased third is filled with the view's number."""
    return ((f[:, None] & _KEEP) ^ _FLIP) ^ _mixed(_VIEW + np.uint64(1))


def _emit(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("simhash", bool)
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(every), 8_192):
                f = every[i : i + 8_192]
                bucket = (_mixed(variants(f)) % np.uint64(buckets)).astype(np.int32).ravel()
                order = np.argsort(bucket, kind="stable")
                counts = np.bincount(bucket, minlength=buckets)
                at, code = f[order // len(_KEEP)], (order % len(_KEEP)).astype(np.uint8)
                ends = np.cumsum(counts)
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array([at[ends[b] - counts[b] : ends[b]].tobytes() for b in used], pa.binary()), pa.array([code[ends[b] - counts[b] : ends[b]].tobytes() for b in used], pa.binary())],
                    ["bucket", "fps", "codes"],
                )

    return run


def linked(group: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links in a group: a search in which each fingerprint meets only those not yet reached."""
    out, left = [], np.unique(group)
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                reached = left[near]
                out += [(int(x), int(y)) for y in reached]
                front += list(reached)
                left = left[~near]
    return out


def _meet(table: pa.Table) -> pa.Table:
    f = np.frombuffer(b"".join(table.column("fps").to_pylist()), np.uint64)
    code = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8)
    key = ((f & _KEEP[code]) ^ _FLIP[code]) ^ _mixed(_VIEW + np.uint64(1))[code]
    order = np.argsort(key)
    key, f = key[order], f[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    links: list[tuple[int, int]] = []
    twos = starts[sizes == 2]
    ok = np.bitwise_count(f[twos] ^ f[twos + 1]) <= RADIUS
    links += zip(f[twos][ok].tolist(), f[twos + 1][ok].tolist(), strict=True)
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        links += linked(f[s : s + n])
    kept = np.array(forest(links), np.uint64).reshape(-1, 2).view(np.int64)
    return pa.table({"a": pa.array(kept[:, 0]), "b": pa.array(kept[:, 1])})


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``fp`` and the ``keep`` columns (as ``k0``, ``k1``, ...) of each row."""
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    schema = "".join(f", {c} {t}" for c, t in kept.dtypes[2:])
    return spread(kept).mapInArrow(_scan, f"doc_id long, fp long{schema}")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (long), ``component_id``, ``kept`` and the ``keep`` columns.

    ``component_id`` is the smallest id that links lead to; ``kept`` is true for one document of each component, one
    with that id. Null and empty texts have fingerprint 0 and link like any other; repeated ids and rows stay, each with
    its own fingerprint; a null id takes part in links but names no component while there is another id; an empty table
    gives no rows; columns that are not named are not read.
    """
    lean_batches(docs.sparkSession)
    prints = written(fingerprints(docs, doc_id, text, keep).withColumn("uid", F.monotonically_increasing_id()), "simhash-prints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    nodes = written(prints.groupBy("fp").agg(F.min(first).alias("least")), "simhash-nodes")
    buckets = at_least(128, nodes.count() * len(_KEEP) * VARIANT_BYTES, BUCKET_BYTES)
    edges = nodes.select("fp").mapInArrow(_emit(buckets), "bucket int, fps binary, codes binary").groupBy("bucket").applyInArrow(_meet, "a long, b long")
    found = components(edges)
    of_node = written(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = written(of_node.groupBy("root").agg(F.min("least").alias("least")), "simhash-least")
    of_print = written(of_node.drop("least").join(least, "root").select("fp", "least"), "simhash-classes")
    named = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    return prints.join(of_print, "fp").select("doc_id", "fp", F.col("least.doc_id").alias("component_id"), (F.col("uid") == F.col("least.uid")).alias("kept"), *named)
