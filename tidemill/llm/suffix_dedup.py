"""Removing repeated passages with suffix arrays of shards.

Every byte that lies in a string of ``LEAST`` bytes which also starts in a document with a smaller id goes. The corpus is
packed into parts of a few MB and handled in two rounds of questions that parts send to buckets:

1. A window of ``LEAST`` bytes is keyed by the smallest hash of the ``GRAM``-byte strings in it. Equal windows have equal
   keys, and neighbouring windows mostly share one, so that a run of windows is one entry. Parts ask which of their keys
   another document has: all others hold no repeated window.
2. Parts send the runs of those keys, each distinct text once with the smallest id it has there, to the shard of the key.
   A shard sorts the suffixes of its texts by induced sorting, computes the permuted common prefixes, and so finds the
   groups of equal windows and the smallest id of each; parts get these ids back and remove what they must.

Keys with very many different surroundings (a passage that a third of all documents hold) are dealt out once more, window
by window, by a hash of the whole window, so that no shard receives them all. Texts that are equal meet as one entry for
each part, however many documents hold them; entries of hot windows meet once more, for ``PARTS_MET`` parts together, before
they go to the window's shard, and the answer returns by the same way. The number of buckets grows with the input; a part's and a shard's memory do
not. Questions and answers are written tables or shuffled rows, so a lost executor's are made again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import at_least, drop_written, estimated_bytes, kept_by_worker, lean_batches, spread, written
from .suffix_arrays import common_prefixes, suffix_array

LEAST = 50
GRAM = 20
#: Windows of a run at most.
LONGEST_RUN = 64
PART_BYTES = 2 << 20
#: Bytes of input, as stored, for each bucket.
BUCKET_BYTES = 3 << 20
#: Distinct surroundings of a key, summed over parts, above which its windows are dealt out one by one.
HOT = 3000
#: Parts whose entries of a hot window meet before the window's shard gets one entry for all of them.
PARTS_MET = 4096
#: Bytes that are sorted at once: their arrays should fit a processor's cache.
SORTED_BYTES = 1 << 20
END = 0xFF  # no byte of UTF-8

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_NOBODY = np.iinfo(np.int64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=5).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


class Part:
    """Documents one after another, each closed by END, with their ids (null: the largest)."""

    def __init__(self, texts: pa.Array, ids: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n and texts.buffers()[2] else np.zeros(0, np.uint8)
        lengths = np.diff(offsets)
        self.ids = ids.cast(pa.int64()).fill_null(_NOBODY).to_numpy(zero_copy_only=False)
        self.doc = np.repeat(np.arange(n), lengths + 1)
        self.bytes = np.full(len(data) + n, END, np.uint8)
        self.bytes[np.arange(len(data)) + np.repeat(np.arange(n), lengths)] = data
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.lengths = lengths
        padded = np.concatenate([self.bytes, np.zeros(64, np.uint8)])
        self.eight = np.ndarray((len(self.bytes) + 56,), "<u8", buffer=padded, strides=(1,))

    def runs(self) -> None:
        """``run_start``, ``run_size`` (windows), ``run_key``: runs of windows with one key."""
        windows = np.maximum(0, self.lengths - LEAST + 1)
        valid = np.arange(windows.sum()) + np.repeat(self.starts - (np.cumsum(windows) - windows), windows)
        if not len(valid):
            self.run_start = self.run_size = np.zeros(0, np.int64)
            self.run_key = np.zeros(0, np.uint64)
            return
        n = len(self.bytes) - GRAM + 1
        low = _mixed(self.eight[:n] * _A ^ _mixed(self.eight[8 : 8 + n] * _B) ^ self.eight[GRAM - 8 : GRAM - 8 + n] * _C)
        wide, have = LEAST - GRAM + 1, 1
        while have < wide:
            step = min(have, wide - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        key = low[valid]
        edge = np.concatenate([[True], (key[1:] != key[:-1]) | (np.diff(valid) != 1)])
        at = np.flatnonzero(edge)
        size = np.diff(np.append(at, len(valid)))
        if size.max(initial=0) > LONGEST_RUN:
            pieces = -(-size // LONGEST_RUN)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at = np.repeat(at, pieces) + nth * LONGEST_RUN
            size = np.minimum(np.repeat(size, pieces) - nth * LONGEST_RUN, LONGEST_RUN)
        self.run_start, self.run_size, self.run_key = valid[at], size, _mixed(key[at] * _B)

    def digest(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each string."""
        out = _mixed(length.astype(np.uint64) * _C)
        here = np.arange(len(start))
        k = 0
        while len(here):
            word = self.eight[start[here] + k]
            left = length[here] - k
            short = left < 8
            word[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            out[here] = _mixed((out[here] ^ word) * _A)
            k += 8
            here = here[left > 8]
        return out

    def keys(self, ask: bool) -> None:
        """``key`` (each once, in order) and ``key_of_run``; to ask, of each key its surroundings and whether two documents have it."""
        self.runs()
        order = np.argsort(self.run_key)
        key = self.run_key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        first = np.flatnonzero(new)
        nth = np.cumsum(new) - 1
        self.key, self.key_of_run = key[first], np.empty(len(key), np.int64)
        self.key_of_run[order] = nth
        if not ask or not len(key):
            return
        doc = self.ids[self.doc[self.run_start[order]]]
        self.two = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        self.around = np.ones(len(first), np.int64)
        again = np.repeat(np.diff(np.append(first, len(key))) > 1, np.diff(np.append(first, len(key))))
        if again.any():
            runs = order[again]
            text = self.digest(self.run_start[runs], self.run_size[runs] + LEAST - 1)
            pair = np.unique((nth[again].astype(np.uint64) << np.uint64(40)) | (text >> np.uint64(24)))
            k, n = np.unique(pair >> np.uint64(40), return_counts=True)
            self.around[k.astype(np.int64)] = n


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places that go to it, in order."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cut) if len(order) else []:
        yield int(bucket[at[0]]), at


# -- packing documents into parts


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_by_worker("suffixes", bool)  # another operator's cache goes
    part = TaskContext.get().partitionId() << 24
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))

    def row(table: pa.Table) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=options) as w:
            w.write_table(table.combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "docs"])

    held, size = [], 0
    for batch in batches:
        step = max(1, min(batch.num_rows, PART_BYTES * batch.num_rows // max(1, 4 * batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            held.append(batch.slice(i, step))
            size += held[-1].nbytes
            if size >= PART_BYTES:
                yield row(pa.Table.from_batches(held))
                held, size, part = [], 0, part + 1
    if held:
        yield row(pa.Table.from_batches(held))


def _docs(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all().combine_chunks()


def _part(packed: bytes) -> tuple[pa.Table, Part]:
    t = _docs(packed)
    column = lambda i: t.column(i).chunk(0) if t.column(i).num_chunks else pa.array([], t.schema.field(i).type)
    return t, Part(column(t.num_columns - 1), column(t.num_columns - 2))


# -- round 1: which keys does another document have?


def _ask_keys(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("suffixes", bool)
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, p = _part(packed)
                p.keys(ask=True)
                if not len(p.key):
                    continue
                five = np.ascontiguousarray(p.key.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
                rows = [(b, five[at].tobytes(), _packed(np.stack([np.minimum(p.around[at], 65535), p.two[at]]).astype("<u2").tobytes())) for b, at in _slices(_bucket(p.key, buckets))]
                b, k, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([name] * len(rows), pa.int64()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], ["bucket", "part", "keys", "counts"])

    return run


def _answer_keys(t: pa.Table) -> pa.Table:
    sizes, keys, counts = [], [], []
    for k, c in zip(t.column("keys").to_pylist(), t.column("counts").to_pylist(), strict=True):
        raw = np.zeros((len(k) // 5, 8), np.uint8)
        raw[:, :5] = np.frombuffer(k, np.uint8).reshape(-1, 5)
        keys.append(raw.view("<u8").ravel())
        counts.append(np.frombuffer(_unpacked(c), "<u2").reshape(2, -1))
        sizes.append(len(raw))
    key, count = np.concatenate(keys), np.concatenate(counts, axis=1)
    order = np.argsort(key)
    s = key[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    n = np.diff(np.append(starts, len(s)))
    shared = (n > 1) | (np.maximum.reduceat(count[1][order], starts) > 0)
    around = np.add.reduceat(count[0][order].astype(np.int64), starts)
    answer = np.empty(len(key), np.uint8)
    answer[order] = np.repeat(np.where(shared, np.where(around > HOT, 2, 1), 0).astype(np.uint8), n)
    ends = np.cumsum(sizes)
    parts, out = [], []
    for name, e, m in zip(t.column("part").to_pylist(), ends, sizes, strict=True):
        if (mine := answer[e - m : e]).any():
            parts.append(name)
            out.append(_packed(mine.tobytes()))
    return pa.table({"part": pa.array(parts, pa.int64()), "bucket": pa.array([t.column("bucket")[0].as_py()] * len(parts), pa.int32()), "answer": pa.array(out, pa.binary())})


# -- round 2: the shards' suffix arrays


def _ask_shards(buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"part": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "lengths": pa.array([], pa.binary()), "groups": pa.array([], pa.binary()), "owners": pa.array([], pa.binary()), "texts": pa.array([], pa.binary()), "places": pa.array([], pa.binary())})
        if not left.num_rows or not right.num_rows:
            return none
        _, p = _part(left.column("docs")[0].as_py())
        p.keys(ask=False)
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist(), strict=True))
        state = np.zeros(len(p.key), np.uint8)
        for b, at in _slices(_bucket(p.key, buckets)):
            if b in answers:
                state[at] = np.frombuffer(_unpacked(answers[b]), np.uint8)
        of_run = state[p.key_of_run]
        plain, hot = of_run == 1, of_run == 2
        start, windows, key = p.run_start[plain], p.run_size[plain], p.run_key[plain]
        n = p.run_size[hot]
        single = np.repeat(p.run_start[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.concatenate([start, single])
        length = np.concatenate([windows, np.ones(len(single), np.int64)]) + LEAST - 1
        text = p.digest(start, length)
        shard_key = np.concatenate([key, _mixed(text[len(key) :] * _C)])
        doc = p.ids[p.doc[start]]
        # Equal texts are one entry, with the smallest id.
        order = np.lexsort((text, shard_key))
        new = np.concatenate([[True], (text[order][1:] != text[order][:-1]) | (shard_key[order][1:] != shard_key[order][:-1])])
        entry = np.empty(len(start), np.int64)
        entry[order] = np.cumsum(new) - 1
        first = order[new]
        owner = np.minimum.reduceat(doc[order], np.flatnonzero(new))
        rows, place = [], np.empty(len(first), np.int64)
        done = 0
        # Hot windows have shards of their own, numbered after the others.
        shards = _bucket(shard_key[first], buckets) + np.where(first < len(key), 0, buckets)
        for b, at in _slices(shards):
            s, n = start[first[at]], length[first[at]]
            spread = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows.append((b, _packed(n.astype("<u2").tobytes()), (shard_key[first[at]] & np.uint64(255)).astype(np.uint8).tobytes(), _packed(owner[at].astype("<i8").tobytes()), _packed(p.bytes[spread].tobytes()), b""))
            place[at] = np.arange(done, done + len(at))
            done += len(at)
        # For the part itself: where each entry's texts are, in the order of the shards' answers.
        by = np.lexsort((start, place[entry]))
        mine = np.stack([np.diff(place[entry][by], prepend=0), start[by], length[by]]).astype("<i4")
        rows.append((-1, b"", b"", b"", b"", _packed(mine.tobytes())))
        shard, lengths, groups, owners, texts, places = zip(*rows, strict=True)
        name = left.column("part")[0].as_py()
        return pa.table({"part": pa.array([name] * len(rows), pa.int64()), "shard": pa.array(shard, pa.int32()), "lengths": pa.array(lengths, pa.binary()), "groups": pa.array(groups, pa.binary()), "owners": pa.array(owners, pa.binary()), "texts": pa.array(texts, pa.binary()), "places": pa.array(places, pa.binary())})

    return run


def least_owners(texts: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Of each window of each text, one text after another: the smallest owner of an equal window.

    ``texts``: the texts' bytes one after another.
    """
    n = len(lengths)
    t = np.full(len(texts) + n, END, np.uint8)
    t[np.arange(len(texts)) + np.repeat(np.arange(n), lengths)] = texts
    starts = np.cumsum(lengths + 1) - lengths - 1
    windows = lengths - LEAST + 1
    valid = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    order = suffix_array(t, depth=LEAST + 8)
    shared = common_prefixes(t, order, LEAST, valid)
    is_window = np.zeros(len(t), bool)
    is_window[valid] = True
    order = order[is_window[order]]
    # A suffix that is no window shares fewer bytes, for an END comes before them; so groups have windows only.
    first = np.flatnonzero(np.concatenate([[True], shared[order[1:]] < LEAST]))
    owner = np.zeros(len(t), np.int64)
    owner[valid] = np.repeat(owners, windows)
    least = np.minimum.reduceat(owner[order], first)
    owner[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    return owner[valid]


class _Asked:
    """What several rows ask one shard, in the order of their parts: equal texts are one, with the smallest of their owners."""

    def __init__(self, t: pa.Table):
        self.t = t = t.sort_by("part")
        self.lengths = [np.frombuffer(_unpacked(x), "<u2").astype(np.int64) for x in t.column("lengths").to_pylist()]
        owners = np.concatenate([np.frombuffer(_unpacked(x), "<i8") for x in t.column("owners").to_pylist()])
        whole = b"".join(map(_unpacked, t.column("texts").to_pylist()))
        every = np.concatenate(self.lengths)
        starts = np.cumsum(every) - every
        seen: dict[bytes, int] = {}
        self.which = np.fromiter((seen.setdefault(whole[s : s + n], len(seen)) for s, n in zip(starts.tolist(), every.tolist(), strict=True)), np.int64, len(every))
        self.distinct = list(seen)
        self.least = np.full(len(seen), _NOBODY)
        np.minimum.at(self.least, self.which, owners)
        self.sizes = np.fromiter(map(len, self.distinct), np.int64, len(seen))
        self.windows = self.sizes - LEAST + 1
        self.begin = np.cumsum(self.windows) - self.windows
        self.group = np.zeros(len(seen), np.uint8)
        self.group[self.which] = np.frombuffer(b"".join(t.column("groups").to_pylist()), np.uint8)

    def answers(self, found: np.ndarray) -> pa.Table:
        """For each row the owners of its windows; ``found``: those of the distinct texts' windows."""
        out, at = [], 0
        for n in self.lengths:
            w = self.which[at : at + len(n)]
            at += len(n)
            k = self.windows[w]
            back = found[np.repeat(self.begin[w] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            out.append(_packed(np.diff(back, prepend=0).astype("<i8").tobytes()))
        return pa.table({"part": self.t.column("part"), "shard": self.t.column("shard"), "answer": pa.array(out, pa.binary())})


def _meet(t: pa.Table) -> pa.Table:
    """One question for those of several parts, under the number of their meeting."""
    a = _Asked(t)
    columns = {"lengths": _packed(a.sizes.astype("<u2").tobytes()), "groups": a.group.tobytes(), "owners": _packed(a.least.astype("<i8").tobytes()), "texts": _packed(b"".join(a.distinct))}
    where = {"part": pa.array([t.column("meeting")[0].as_py()], pa.int64()), "shard": pa.array([t.column("shard")[0].as_py()], pa.int32())}
    return pa.table(where | {c: pa.array([v], pa.binary()) for c, v in columns.items()})


def _part_ways(left: pa.Table, right: pa.Table) -> pa.Table:
    """The answer to a meeting as one for each of its parts."""
    return _Asked(left).answers(np.cumsum(np.frombuffer(_unpacked(right.column("answer")[0].as_py()), "<i8")))


def _answer_shards(t: pa.Table) -> pa.Table:
    a = _Asked(t)
    # Equal windows have equal keys, so texts of different keys need not be sorted together.
    group = a.group.astype(np.int64) % max(1, -(-int(a.sizes.sum()) // SORTED_BYTES))
    found = np.empty(a.windows.sum(), np.int64)
    for _, at in _slices(group):
        k = a.windows[at]
        found[np.repeat(a.begin[at] - (np.cumsum(k) - k), k) + np.arange(k.sum())] = least_owners(np.frombuffer(b"".join([a.distinct[i] for i in at]), np.uint8), a.sizes[at], a.least[at])
    return a.answers(found)


# -- removing


def _remove_as_text(left: pa.Table, right: pa.Table) -> pa.Table:
    out = _remove(left, right)
    texts = pa.array([b.decode("utf-8", "ignore") for b in out.column("kept_bytes").to_pylist()], pa.string())
    return out.set_column(out.num_columns - 1, "kept_text", texts)


def _remove(left: pa.Table, right: pa.Table) -> pa.Table:
    docs, p = _part(left.column("docs")[0].as_py())
    gone = np.zeros(len(p.bytes) + 1, np.int32)
    if right.num_rows:
        rows = sorted(zip(right.column("shard").to_pylist(), right.column("answer").to_pylist(), strict=True))
        entry, start, length = np.frombuffer(_unpacked(rows[0][1]), "<i4").reshape(3, -1).astype(np.int64)
        entry = np.cumsum(entry)
        owner = np.concatenate([np.cumsum(np.frombuffer(_unpacked(a), "<i8")) for _, a in rows[1:]])
        windows = length - LEAST + 1
        of_entry = np.zeros(entry[-1] + 1, np.int64)
        of_entry[entry] = windows
        begin = np.cumsum(of_entry) - of_entry
        nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        at = np.repeat(start, windows) + nth
        hit = at[owner[np.repeat(begin[entry], windows) + nth] < np.repeat(p.ids[p.doc[start]], windows)]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + LEAST, -1)
    gone = np.cumsum(gone[:-1]) > 0
    edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = p.doc[begins] if len(begins) else np.zeros(0, np.int64)
    n_spans = np.bincount(doc, minlength=len(p.lengths))
    base = p.starts[doc] if len(begins) else begins
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(begins - base), pa.array(ends - begins)], ["start", "length"]))
    keep = ~gone
    kept = [p.bytes[s:e][keep[s:e]].tobytes() for s, e in zip(p.starts.tolist(), p.ends.tolist(), strict=True)]
    columns = {c: docs.column(i) for i, c in enumerate(docs.column_names[:-2])}
    return pa.table(columns | {"n_bytes": pa.array(p.lengths), "spans": spans, "kept_bytes": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """One row per document: ``keep`` columns, ``n_bytes``, ``spans`` (array of ``start``, ``length``: what goes), ``kept_bytes``.

    With ``as_text`` the last column is ``kept_text``, without the characters that a cut has left incomplete.

    A null text counts as empty. Documents with one id do not remove each other's bytes, so neither do repeated rows;
    a null id is larger than all others. Texts shorter than LEAST bytes are kept whole. An empty table gives no rows;
    ``keep`` names are free, other columns are not read. What is kept can end within a character: it is bytes.
    """
    lean_batches(docs.sparkSession)
    chosen = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(doc_id).cast("long").alias("id_"), F.col(text).alias("text_"))
    packed = written(spread(chosen).mapInArrow(_pack, "part long, docs binary"), "suffix-parts")
    buckets = at_least(64, estimated_bytes(packed), BUCKET_BYTES)
    asked = packed.mapInArrow(_ask_keys(buckets), "bucket int, part long, keys binary, counts binary")
    shared = asked.groupBy("bucket").applyInArrow(_answer_keys, "part long, bucket int, answer binary")
    sent = packed.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_ask_shards(buckets), "part long, shard int, lengths binary, groups binary, owners binary, texts binary, places binary")
    sent = written(sent, "suffix-runs")
    answers = "part long, shard int, answer binary"
    asked = sent.where("shard >= 0").select("part", "shard", "lengths", "groups", "owners", "texts")
    meetings = at_least(1, packed.count(), PARTS_MET)
    if meetings == 1:
        sorted_ = asked.groupBy("shard").applyInArrow(_answer_shards, answers)
    else:
        hot = asked.where(F.col("shard") >= buckets).withColumn("meeting", F.pmod(F.xxhash64("part"), F.lit(meetings)))
        met = hot.groupBy("shard", "meeting").applyInArrow(_meet, "part long, shard int, lengths binary, groups binary, owners binary, texts binary")
        told = met.groupBy("shard").applyInArrow(_answer_shards, answers).withColumnRenamed("part", "meeting")
        told = hot.groupBy("shard", "meeting").cogroup(told.groupBy("shard", "meeting")).applyInArrow(_part_ways, answers)
        sorted_ = asked.where(F.col("shard") < buckets).groupBy("shard").applyInArrow(_answer_shards, answers).unionByName(told)
    back = written(sorted_.unionByName(sent.where("shard < 0").select("part", "shard", F.col("places").alias("answer"))), "suffix-answers")
    drop_written(sent)
    types = dict(chosen.dtypes)
    schema = ", ".join(f"k{i} {types[f'k{i}']}" for i in range(len(keep)))
    out = packed.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(_remove_as_text if as_text else _remove, f"{schema}, n_bytes long, spans array<struct<start: long, length: long>>, {'kept_text string' if as_text else 'kept_bytes binary'}")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "spans", "kept_text" if as_text else "kept_bytes")
