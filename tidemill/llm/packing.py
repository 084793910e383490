"""Packing documents into token windows by non-negative least squares.

A document is its token ids and an end id. Every full window of it is a sequence by itself; what remains, shorter than
a window, goes through the histogram of remainders:

1. Combinations of two or three lengths that fill a window exactly are enumerated.
2. Non-negative least squares finds repeat counts for which the combinations use up the histogram.
3. The counts are rounded, never beyond what the histogram has.
4. What is left is packed greedily: the longest piece first, then the longest that fits, as long as a window gets full;
   the rest is laid end to end and cut at window ends, so that only the last sequence has padding.

All of this works on counts by length, for blocks of documents: a task reads a split of the input, tokenizes until it
holds ``BLOCK_TOKENS`` ids, plans them and hands out their pieces, whose places follow from the rank of each piece among
those of its length. One sequence in a block has padding, one in 8,000 or so. Nothing is shuffled, collected, broadcast or
written on the way, a task's memory does not depend on the input's size or on how frequent a length is, and a lost task is
simply run again.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from struct import pack as pack_shorts

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import at_least, estimated_bytes, kept_by_worker, lean_batches, spread

WINDOW = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Ids of the documents that are planned together, at least, if a task has them: 32 MB. Each block pads one sequence.
BLOCK_TOKENS = 1 << 24
#: Bytes of input, as estimated, that a task has at least.
PART_BYTES = 4 << 20
#: Words whose ids a worker keeps, twice.
CACHE = 250_000
ITERATIONS = 200


#: Texts of these characters only are split here: what the tokenizer does with them is known from its file. They are in
#: composed form, have plain lower-case forms, and white space and letters are the same to Python and the tokenizer.
_plain = re.compile("[\\t\\n\\r\\x20-\\x7e¡¿À-ÖØ-įı-ɏ]*").fullmatch
#: The tokenizer's own pattern for these characters.
_split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\\sa-zß-öø-ɏ0-9]+").findall


class WordIds(dict):
    """Ids by word, as unsigned 16-bit numbers: those of an older generation, or else encoded."""

    def __init__(self, encode: Callable[[str], bytes], older: dict[str, bytes]):
        self.encode, self.older = encode, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids of whole texts by a tokenizer that lower-cases, splits by a pattern and spells words in signs for bytes.

    Words are encoded once and kept, those used lately longest. Texts with other characters than ``_plain`` ones, or with
    one of the tokenizer's special tokens, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.signs = {c: spell(chr(c))[0][0] for c in range(0x80, 0x250) if _plain(chr(c))}
        self.pieces = self.tokenizer.model.tokenize
        self.known = WordIds(self._encode_word, {})

    def _encode_word(self, word: str) -> bytes:
        found = self.pieces(word if word.isascii() else word.translate(self.signs))
        return pack_shorts(f"<{len(found)}H", *[t.id for t in found])

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as unsigned 16-bit numbers."""
        out: list[bytes] = []
        for t in texts:
            if not _plain(t) or any(s in t for s in self.special):
                out.append(self._encode(t))
                continue
            if len(self.known) > CACHE:
                self.known.older, self.known = {}, WordIds(self._encode_word, self.known)
            out.append(b"".join(map(self.known.__getitem__, _split(t.lower()))))
        return out


# -- the plan, on counts by length


def combinations(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window exactly: all pairs, and triples spread over each length."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    have[0] = True
    rows = [(a, window - a, 0) for a in lengths.tolist() if a <= window - a]
    for a in lengths.tolist():
        for share in range(1, 8):
            b = (window - a) * share // 8
            if b > 0 and window - a - b > 0:
                rows.append(tuple(sorted((a, b, window - a - b), reverse=True)))
    rows = [r for r in set(rows) if have[list(r)].all()]
    return np.array(sorted(rows, reverse=True), np.int64).reshape(-1, 3)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """x >= 0 that makes the lengths used come near the histogram, in least squares, by multiplicative updates.

    Each update multiplies x by (A'h) / (A'Ax), which never raises the squared error and keeps x non-negative.
    """
    if not len(combos):
        return np.zeros(0)
    used = combos > 0
    h = histogram.astype(float)
    h[0] = 0
    wanted = (h[combos] * used).sum(1)
    x = np.maximum(1e-9, np.where(used, h[combos], np.inf).min(1) / 8)
    for _ in range(iterations):
        have = np.bincount(combos.ravel(), np.repeat(x, 3) * used.ravel(), len(h))
        x *= wanted / np.maximum((have[combos] * used).sum(1), 1e-12)
    return x


@dataclass
class Layout:
    """Where the piece of a length and rank goes: segments of ranks, by length."""

    window: int
    sequences: int = 0
    lane_start: int = 0
    segments: dict[int, list[tuple[int, bool, int, int]]] = field(default_factory=dict)  # first rank, lane, sequence or position, offset

    def arrays(self) -> dict[int, tuple[np.ndarray, ...]]:
        return {n: tuple(np.array(c, np.int64) for c in zip(*s, strict=True)) for n, s in self.segments.items()}


def plan(counts: dict[int, int], window: int = WINDOW) -> Layout:
    left = np.zeros(window + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    taken = np.zeros_like(left)
    layout = Layout(window)

    def use(lengths: list[int], times: int) -> None:
        at = 0
        for n in lengths:
            layout.segments.setdefault(n, []).append((int(taken[n]), False, layout.sequences, at))
            taken[n] += times
            left[n] -= times
            at += n
        layout.sequences += times

    combos = combinations(np.flatnonzero(left), window)
    x = repeat_counts(combos, left)
    for i in np.argsort(-x, kind="stable"):
        lengths = [int(n) for n in combos[i] if n]
        times = min([round(float(x[i])), *(int(left[n]) // lengths.count(n) for n in lengths)])
        if times > 0:
            use(lengths, times)
    lane = []
    while len(sizes := np.flatnonzero(left)):
        first = int(sizes[-1])
        lengths, room, spare = [first], window - first, left.copy()
        spare[first] -= 1
        while room and len(fit := np.flatnonzero(spare[: room + 1])):
            n = int(fit[-1])
            more = min(int(spare[n]), room // n)
            lengths += [n] * more
            spare[n] -= more
            room -= n * more
        if room:
            lane.append((first, int(left[first])))
            left[first] = 0
        else:
            use(lengths, min(int(left[n]) // lengths.count(n) for n in set(lengths)))
    layout.lane_start, at = layout.sequences, 0
    for n, c in lane:
        layout.segments.setdefault(n, []).append((int(taken[n]), True, at, 0))
        at += n * c
    layout.sequences += -(-at // window)
    return layout


# -- the pass over the documents


DIGESTS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, uid long"
PIECES = "uid long, doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"


class Block:
    """Documents that are planned and packed together, with their ids."""

    def __init__(self, first_uid: int):
        self.first_uid, self.docs, self.ids, self.tokens = first_uid, [], [], 0

    def add(self, docs: pa.Array, ids: list[bytes]) -> None:
        self.docs.append(docs)
        self.ids += ids
        self.tokens += sum(map(len, ids)) // 2

    def pieces(self, window: int, first_sequence: int) -> tuple[int, Iterator[pa.RecordBatch]]:
        """How many sequences the block fills, and its pieces: first those of whole windows, then those of the plan."""
        n = np.array([len(b) // 2 for b in self.ids], np.int64)
        rest, full = n % window, n // window
        counts = np.bincount(rest, minlength=window)
        layout = plan({r: int(c) for r, c in enumerate(counts.tolist()) if r and c}, window)
        # The rank of a document among those with its rest, in their order.
        order = np.argsort(rest, kind="stable")
        rank = np.empty(len(n), np.int64)
        rank[order] = np.arange(len(n)) - (np.cumsum(counts) - counts)[rest[order]]
        full_before = np.cumsum(full) - full
        return int(full.sum()) + layout.sequences, self._rows(window, layout, n, rest, rank, first_sequence + full_before, first_sequence + int(full.sum()))

    def _rows(self, window: int, layout: Layout, n: np.ndarray, rest: np.ndarray, rank: np.ndarray, whole: np.ndarray, base: int) -> Iterator[pa.RecordBatch]:
        where, ids_of = layout.arrays(), pa.chunked_array([d for d in self.docs]).combine_chunks()
        for i in range(0, len(n), 256):
            rows = []
            for k in range(i, min(i + 256, len(n))):
                uid, tokens, left = self.first_uid + k, int(n[k]), int(rest[k])
                rows += [(uid, k, j * window, window, tokens, int(whole[k]) + j, 0) for j in range(tokens // window)]
                if not left:
                    continue
                firsts, lane, at_, offset = where[left]
                s = int(np.searchsorted(firsts, rank[k], "right")) - 1
                begin, nth = tokens - left, int(rank[k]) - int(firsts[s])
                if not lane[s]:
                    rows.append((uid, k, begin, left, tokens, base + int(at_[s]) + nth, int(offset[s])))
                    continue
                at = int(at_[s]) + nth * left
                while left:
                    size = min(left, window - at % window)
                    rows.append((uid, k, begin, size, tokens, base + layout.lane_start + at // window, at % window))
                    at, begin, left = at + size, begin + size, left - size
            uid, at, *others = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            # A document's pieces come in the order of its ids, so the ids need no copy.
            flat = np.frombuffer(b"".join(self.ids[i : i + 256]), "<u2").astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(others[1])]).astype(np.int32)
            columns = [pa.array(uid), ids_of.take(pa.array(at)), *map(pa.array, others)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["uid", "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def _pack(path: str, window: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (np.int64(TaskContext.get().partitionId()) << np.int64(33)).item()
        uid, sequence, tokenizer, block = first, first, None, None
        for batch in batches:
            tokenizer = tokenizer or kept_by_worker(("tokenizer", path), lambda: WordTokenizer(path))
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                block = block or Block(uid)
                block.add(some.column(0), [b + END_ID.to_bytes(2, "little") for b in tokenizer([t or "" for t in some.column(1).to_pylist()])])
                uid += some.num_rows
                if block.tokens >= block_tokens:
                    used, rows = block.pieces(window, sequence)
                    yield from rows
                    sequence, block = sequence + used, None
        if block:
            yield from block.pieces(window, sequence)[1]

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, digest: bool = False, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: ``uid`` (the row's), ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    A null text counts as empty and gives the end id alone; null and repeated ids and equal rows are kept as documents
    of their own; an empty table gives no rows; other columns are not read. ``path`` is the tokenizer's file. Only the last
    sequence of each block is padded. With ``digest`` the rows are those of :func:`with_crc32`, made in the same pass.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    lean_batches(docs.sparkSession)
    # Splits that are too small for a block of their own share a task: fewer blocks, less padding.
    parts = at_least(1, estimated_bytes(docs), PART_BYTES)
    run = _pack(path, window, block_tokens)
    chosen = spread(docs.select(F.col("doc_id").cast("long"), "text"), parts).coalesce(parts)
    return chosen.mapInArrow(lambda batches: _digest(run(batches)), DIGESTS) if digest else chosen.mapInArrow(run, PIECES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[s:e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "length")), pa.array(crc, pa.int64()), *(b.column(c) for c in ("doc_tokens", "sequence_id", "offset", "uid"))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "uid"])


def with_crc32(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``: crc32 of the ids as little-endian unsigned 32-bit numbers; ``uid`` comes last."""
    return pieces.mapInArrow(_digest, DIGESTS)
