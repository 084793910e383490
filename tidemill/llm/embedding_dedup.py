"""Near-duplicate embeddings by NN-descent.

Equal vectors become one node that counts its copies. A neighbour graph starts from sorted random-hyperplane codes: in
each of ``TREES`` orders a vector meets those around it. Then rounds of neighbours-of-neighbours joins refine it: each
node joins a sample of its neighbours, forward and reverse and new ones first, with each other, and what they find
enters their lists. A list holds every link (cosine at the threshold or above) that was found and ``NEIGHBOURS`` more.

The descent has to find the groups (connected components of the links), not every link of a group: block products within
a group count its links exactly, so a saturated list costs nothing. An audit compares a fixed number of vectors with all
others, in blocks. Further attempts, each with more new orders, wider windows and larger samples, follow until its recall
is ``RECALL``, over links and over vectors, and an attempt's orders meet no link between two groups that were apart. No
attempt is the last whatever it found.

Cosines are computed in double precision from the vectors as they are. Only links enter the result, so none lies below
the threshold; the audit only measures. What can be missing is a link between two groups that no attempt met.

Scale: an order is cut by range partitions and swept in blocks, so that equal codes are no hot group. A round moves a
sample of each list with its vectors, not all pairs, and between attempts a list forgets links within its group. The
products of a group of n distinct vectors are n^2, as the contract's own count is; its rows, dealt as pairs of chunks, are
about n^1.5 / 8, and no row is made for a link. Exact copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import at_least, drop_written, estimated_bytes, written

THRESHOLD = 0.95
NEIGHBOURS = 8
TREES = 5
BLOCK = 64
SAMPLE = 12
#: A window's distance matrix is held at once, so windows grow to this; orders are added without end.
WIDEST = 1024
AUDITED = 512
RECALL = 0.98
MOST_ROUNDS = 6
BITS = 60
#: A group of at most this many vectors is one block.
CHUNK = 512

PAIRS = "a long, b long, sim double"


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of vectors that can link: not null, no null or non-finite component, not zero."""
    for batch in batches:
        out = []
        for v in batch.column(1):
            x = v.values.to_numpy(zero_copy_only=False) if v.is_valid and not v.values.null_count else np.zeros(0)
            # Adding zero makes -0.0 the same bytes as 0.0.
            out.append((x + x.dtype.type(0)).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])


def _unit(rows: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    # A power of two brings the largest component near 1: exact, and no square over- or underflows.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _near(x: np.ndarray, ids: np.ndarray, root: np.ndarray, few: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of x: each row's links with rows of another ``root``, and its nearest ``few`` others of those."""
    sim = np.minimum(x @ x.T, 1.0)
    settled = root[:, None] == root[None, :]
    sim[settled] = -2.0
    take = sim >= threshold
    if len(x) > few:
        best = np.argpartition(-sim, few, axis=1)[:, :few]
        take[np.arange(len(x))[:, None], best] = True
    else:
        take |= few > 0
    take[settled] = False
    i, j = np.nonzero(take)
    return ids[i], ids[j], sim[i, j]


def _rows(a, b, sim) -> pa.RecordBatch:
    """Pairs as a batch, each once."""
    a, b, sim = np.concatenate(a), np.concatenate(b), np.concatenate(sim)
    order = np.lexsort((b, a))
    a, b, sim = a[order], b[order], sim[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(sim[first])], ["a", "b", "sim"])


def _codes(kind: str, seed: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(BITS, dtype=np.int64)[::-1]
        for batch in batches:
            by_size: dict[int, list[int]] = {}
            vecs = batch.column(1).to_pylist()
            for i, v in enumerate(vecs):
                by_size.setdefault(len(v), []).append(i)
            for size, rows in by_size.items():
                x = _unit([vecs[i] for i in rows], kind)
                if size not in planes:
                    planes[size] = np.random.default_rng((seed, x.shape[1])).standard_normal((trees, x.shape[1], BITS))
                at = pa.array(np.array(rows))
                for t in range(trees):
                    code = ((x @ planes[size][t]) > 0) @ weight
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(np.full(len(rows), size, np.int32)), pa.array(code), batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at)], ["tree", "bytes", "code", "node", "vec", "root"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int, overlap: int) -> Iterator[tuple[list, pa.RecordBatch]]:
    """Runs of rows with equal keys, in batches that are sorted by them, at most ``most`` rows at once."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        yield from (groups := _cut(held, keys, most, overlap, False))[0]
        held = groups[1]
    if held is not None and held.num_rows:
        yield from _cut(held, keys, most, overlap, True)[0]


def _cut(t: pa.Table, keys: list[str], most: int, overlap: int, last: bool) -> tuple[list[pa.Table], pa.Table]:
    if not t.num_rows:
        return [], t
    columns = [t.column(k).to_numpy() for k in keys]
    edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    starts, ends = np.concatenate([[0], edge]), np.append(edge, t.num_rows)
    out, keep = [], t.num_rows
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        open_end = e == t.num_rows and not last
        while e - s > most:
            out.append(t.slice(s, most))
            s += most - overlap
        if open_end:
            keep = s
        else:
            out.append(t.slice(s, e - s))
    return out, t.slice(keep)


def first_graph(nodes: DataFrame, kind: str, seed: int, trees: int, threshold: float, block: int = BLOCK, few: int = NEIGHBOURS) -> DataFrame:
    """Pairs of ``nodes`` (``node``, ``vec``, ``root``) that stand close to each other in an order."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, sim, n = [], [], [], 0
        for t in _groups(batches, ["tree", "bytes"], block, block // 2):
            if t.num_rows > 1:
                i, j, s = _near(_unit(t.column("vec").to_pylist(), kind), t.column("node").to_numpy(), t.column("root").to_numpy(), few, threshold)
                a.append(i), b.append(j), sim.append(s)
                n += len(i)
            if n > 200_000:
                yield _rows(a, b, sim)
                a, b, sim, n = [], [], [], 0
        if n:
            yield _rows(a, b, sim)

    coded = nodes.select("node", "vec", "root").mapInArrow(_codes(kind, seed, trees), "tree int, bytes int, code long, node long, vec binary, root long")
    parts = at_least(12, estimated_bytes(nodes) * trees, 4 << 20)
    return coded.repartitionByRange(parts, "tree", "bytes", "code", "node").sortWithinPartitions("tree", "bytes", "code", "node").mapInArrow(sweep, PAIRS)


def refine(lists: DataFrame, found: DataFrame, threshold: float, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``a``, ``b``, ``sim``, ``fresh``: the lists with what was found; all links and the nearest others."""
    both = found.withColumn("fresh", F.lit(1)).unionByName(lists) if lists is not None else found.withColumn("fresh", F.lit(1))
    each = both.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("a", F.col("sim") >= threshold).orderBy(F.desc("sim"), "b")))
    return ranked.where((F.col("sim") >= threshold) | (F.col("rank") <= neighbours)).drop("rank")


def descend(lists: DataFrame, nodes: DataFrame, kind: str, turn: int, threshold: float, sample: int = SAMPLE) -> DataFrame:
    """One neighbours-of-neighbours join: pairs that a node's sampled neighbours form with each other."""
    link = (F.col("sim") >= threshold).cast("int")
    sides = lists.select("a", "b", "fresh", link.alias("link")).unionByName(lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "fresh", link.alias("link")))
    dice = F.xxhash64("a", "b", F.lit(turn))
    # A node that very many lists hold is sampled in two steps, so that its reverse list is never sorted in one task.
    step = Window.partitionBy("a", "salt", "link").orderBy(F.desc("fresh"), dice)
    last = Window.partitionBy("a", "link").orderBy(F.desc("fresh"), dice)
    sampled = sides.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(16))).withColumn("r", F.row_number().over(step)).where(F.col("r") <= sample).withColumn("r", F.row_number().over(last)).where(F.col("r") <= sample)
    sampled = written(sampled.groupBy("a", "b").agg(F.max("fresh").alias("fresh")), "descent-sample")
    active = sampled.groupBy("a").agg(F.max("fresh").alias("any")).where("any = 1").select("a")
    with_vectors = sampled.join(active, "a").join(nodes.select(F.col("node").alias("b"), "vec", "root"), "b")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, sim, n = [], [], [], 0
        for t in _groups(batches, ["a"], 2 * sample, 0):
            sizes: dict[int, list[int]] = {}
            vecs, ids, root, fresh = t.column("vec").to_pylist(), t.column("b").to_numpy(), t.column("root").to_numpy(), t.column("fresh").to_numpy() > 0
            for i, v in enumerate(vecs):
                sizes.setdefault(len(v), []).append(i)
            for rows in sizes.values():
                if len(rows) > 1:
                    i, j, s = _near(_unit([vecs[k] for k in rows], kind), np.array(rows), root[rows], 3, threshold)
                    new = fresh[i] | fresh[j]
                    a.append(ids[i[new]]), b.append(ids[j[new]]), sim.append(s[new])
                    n += int(new.sum())
            if n > 400_000:
                yield _rows(a, b, sim)
                a, b, sim, n = [], [], [], 0
        if n:
            yield _rows(a, b, sim)

    parts = at_least(12, estimated_bytes(nodes) * sample, 4 << 20)
    return with_vectors.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(meet, PAIRS)


def audit(nodes: DataFrame, kind: str, threshold: float, audited: int = AUDITED) -> DataFrame:
    """All links of ``audited`` nodes, chosen by a hash, against all nodes."""
    some = nodes.orderBy(F.xxhash64("node"), "node").limit(audited).collect()  # a fixed number of vectors
    sent = nodes.sparkSession.sparkContext.broadcast([(r["node"], bytes(r["vec"])) for r in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list] = {}
        for node, v in sent.value:
            asked.setdefault(len(v), []).append((node, v))
        queries = {n: (np.array([q[0] for q in qs]), _unit([q[1] for q in qs], kind)) for n, qs in asked.items()}
        for batch in batches:
            ids, vecs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for n, (q, x) in queries.items():
                for i in range(0, len(vecs), 4096):
                    at = np.array([k for k in range(i, min(i + 4096, len(vecs))) if len(vecs[k]) == n])
                    if len(at):
                        sim = np.minimum(x @ _unit([vecs[k] for k in at], kind).T, 1.0)
                        r, c = np.nonzero(sim >= threshold)
                        other = q[r] != ids[at[c]]
                        yield pa.RecordBatch.from_arrays([pa.array(q[r][other]), pa.array(ids[at[c]][other]), pa.array(sim[r, c][other])], ["a", "b", "sim"])

    return nodes.select("node", "vec").mapInArrow(run, PAIRS)


def find_groups(nodes: DataFrame, kind: str, threshold: float = THRESHOLD, least_recall: float = RECALL, most_rounds: int = MOST_ROUNDS) -> tuple[DataFrame, float]:
    """``node``, ``root`` of the ``nodes`` (``node``, ``vec``) that link with another, and the audit's recall.

    The recall is the lower of two shares: of the audited links those whose ends are in one group, and of the audited
    vectors that link those with all their links in their group.
    """
    true = written(audit(nodes, kind, threshold), "descent-audit")
    now = nodes.withColumn("root", F.col("node"))
    lists, roots, recall, attempt = None, None, 0.0, 0
    while True:
        more = attempt + 1
        # What later orders meet counts only if it joins two groups; a vector's nearest others are in its list by then.
        first = first_graph(now, kind, 1 + attempt, TREES * more, threshold, min(WIDEST, BLOCK << min(attempt, 8)), 0 if attempt else NEIGHBOURS)
        first = written(first, "descent-orders")
        met = not first.isEmpty()
        if roots is not None and not met and recall >= least_recall:
            break
        if roots is None or met:
            lists = _next(lists, written(refine(lists, first, threshold), "descent-lists"))
            links = lists.where(F.col("sim") >= threshold).count()
            for turn in range(most_rounds):
                old = lists.withColumn("fresh", F.lit(0))
                grown = written(refine(old, descend(lists, now, kind, turn + attempt * most_rounds, threshold, SAMPLE * more), threshold), "descent-lists")
                lists, before = _next(lists, grown), links
                links = lists.where(F.col("sim") >= threshold).count()
                if turn and links - before <= 0.002 * links:
                    break
            edges = lists.where(F.col("sim") >= threshold).select("a", "b")
            if roots is not None:
                edges = edges.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = _next(roots, written(components(edges), "descent-roots"))
            recall = _recall(true, roots)
            lists = _next(lists, written(_forget(lists, threshold), "descent-lists"))
            now = written(nodes.join(roots, "node", "left").select("node", "vec", F.coalesce("root", "node").alias("root")), "descent-nodes")
        drop_written(first)
        attempt += 1
    return roots, recall


def _recall(true: DataFrame, roots: DataFrame) -> float:
    ends = true.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    each = ends.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("ra") == F.col("rb"), F.lit(False)).cast("long")).alias("found"))
    r = each.agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("n"), F.sum("found").alias("found"), F.sum((F.col("n") == F.col("found")).cast("long")).alias("whole")).first()
    return min(r.found / r.n, r.whole / r.nodes) if r.nodes else 1.0


def _forget(lists: DataFrame, threshold: float) -> DataFrame:
    """The lists with the nearest ``NEIGHBOURS`` links only; the roots keep what the others joined."""
    rank = F.row_number().over(Window.partitionBy("a", F.col("sim") >= threshold).orderBy(F.desc("sim"), "b"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= NEIGHBOURS).select("a", "b", "sim", F.lit(0).alias("fresh"))


def count_links(grouped: DataFrame, kind: str, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """``node``, ``others``: how many copies of the other vectors of its group link with each of ``grouped`` (``node``, ``root``, ``vec``, ``copies``).

    Exact: every pair of a group is compared. A group above ``chunk`` is dealt into chunks, and each pair of chunks is a
    block of its own.
    """
    sizes = written(grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.when(F.col("n") <= chunk, 1).otherwise(F.ceil(F.sqrt(F.col("n") * 8.0 / chunk)))), "group-sizes")
    rows = sizes.agg(F.sum(F.col("n") * F.col("chunks"))).first()[0] or 0
    large = sizes.where("chunks > 1").select("root", "chunks")
    dealt = grouped.join(large, "root", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    blocks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    blocks = blocks.select("root", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "vec", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sums, held = [], [], 0
        for t in _groups(batches, ["root", "lo", "hi"], 1 << 62, 0):
            x, copies = _unit(t.column("vec").to_pylist(), kind), t.column("copies").to_numpy().astype(np.float64)
            low, high = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            left = np.flatnonzero(t.column("chunk").to_numpy() == low)
            right = left if low == high else np.flatnonzero(t.column("chunk").to_numpy() == high)
            y, total = x[right], np.zeros(len(x))
            for i in range(0, len(left), 256):
                at = left[i : i + 256]
                near = (x[at] @ y.T >= threshold).astype(np.float64)
                if low == high:
                    near[np.arange(len(at)), np.arange(i, i + len(at))] = 0
                else:
                    total[right] += copies[at] @ near
                total[at] += near @ copies[right]
            nodes.append(t.column("node").to_numpy()), sums.append(total.astype(np.int64))
            held += len(x)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sums))], ["node", "others"])
                nodes, sums, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sums))], ["node", "others"])

    keys = ["root", "lo", "hi"]
    counted = blocks.repartition(at_least(12, rows, 20_000), *keys).sortWithinPartitions(*keys).mapInArrow(run, "node long, others long")
    return counted.groupBy("node").agg(F.sum("others").alias("others"))


def _next(old: DataFrame | None, new: DataFrame) -> DataFrame:
    if old is not None:
        drop_written(old)
    return new


def near_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Null, zero and non-finite vectors and those with a null component link with nothing, as do vectors of different
    length with each other. Repeated ids are vectors of their own; a null id counts as a link, and names a component only
    if no other does. An empty table gives no rows; other columns are not read.
    """
    kind = "<f8" if "double" in dict(table.dtypes)[embedding] else "<f4"
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).mapInArrow(_usable, "vec_id long, vec binary")
    rows = written(rows.withColumn("key", F.md5("vec")), "vectors")
    classes = rows.where("vec is not null").groupBy("key").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    roots, _ = find_groups(classes.select("node", "vec"), kind, threshold)
    counted = count_links(classes.select("node", "vec", "copies").join(roots, "node"), kind, threshold)
    known = classes.select("node", "key", "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = written(known.join(counted, "node", "left").select("key", "root", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "vector-roots")
    least = written(known.groupBy("root").agg(F.min("least").alias("component_id")), "vector-least")
    known = written(known.join(least, "root").select("key", "n_links", "component_id"), "vector-known")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").eqNullSafe(F.col("component_id"))))


ORACLE = r"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS vec_id, coalesce(max(n_links), 0)::BIGINT AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept
FROM r LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = r.a GROUP BY r.a
"""
