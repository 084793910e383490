"""Suffix arrays by induced sorting, whole buckets at a time.

The classic algorithm: suffixes are classified as smaller or larger than the next, the leftmost smaller ones start
substrings whose order is found by inducing, equal substrings share a name, the string of names is sorted recursively,
and the whole order is induced from it in linear time. Inducing one suffix after another would be slow here; a bucket
receives its suffixes in order, so all that a bucket holds is handled by one array operation, and again for those that
repeat the bucket's own character. Names are too many for buckets of that kind, so the recursion names pairs of
neighbouring names instead, then pairs of pairs.

With ``depth`` the order is exact for that many characters, and suffixes that agree in them stand together in any
order: substrings at least that long need no further names.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is larger than the empty one."""
    n = len(t)
    differs = np.append(t[1:] != t[:-1], True)
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    less = np.append(t[:-1] < t[1:], False)
    return less[at]


def _deal(into: list[list[np.ndarray]], suffixes: np.ndarray, first: np.ndarray) -> None:
    """Appends suffixes to the buckets of their first characters, in order."""
    if not len(suffixes):
        return
    order = np.argsort(first, kind="stable")
    suffixes = suffixes[order]
    counts = np.bincount(first, minlength=256)
    ends = np.cumsum(counts)
    for c in np.flatnonzero(counts).tolist():
        into[c].append(suffixes[ends[c] - counts[c] : ends[c]])


_NONE = np.zeros(0, np.int32)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else _NONE


def _induce(t: np.ndarray, leftmost: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """All suffixes in order, given the leftmost smaller ones in theirs; and those of smaller type by bucket."""
    n = len(t)
    seeds: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal(seeds, leftmost, t[leftmost])
    pushed: list[list[np.ndarray]] = [[] for _ in range(256)]
    pushed[int(t[n - 1])].append(np.array([n - 1], np.int32))
    larger: list[np.ndarray] = [_NONE] * 256
    for c in range(256):
        block, held = _joined(pushed[c]), []
        pushed[c] = []
        while len(block):
            held.append(block)
            before = block[block > 0] - np.int32(1)
            first = t[before]
            same = first == c
            up = first > c
            _deal(pushed, before[up], first[up])
            block = before[same]
        larger[c] = _joined(held)
        for part in seeds[c]:
            before = part[part > 0] - np.int32(1)
            first = t[before]
            up = first > c
            _deal(pushed, before[up], first[up])
    pushed = [[] for _ in range(256)]
    smaller: list[np.ndarray] = [_NONE] * 256
    for c in range(255, -1, -1):
        block, held = _joined(pushed[c]), []
        pushed[c] = []
        while len(block):
            held.append(block)
            before = block[block > 0] - np.int32(1)
            first = t[before]
            same = first == c
            down = first < c
            _deal(pushed, before[down], first[down])
            block = before[same]
        smaller[c] = _joined(held)[::-1]
        back = larger[c][::-1]
        before = back[back > 0] - np.int32(1)
        first = t[before]
        down = first < c
        _deal(pushed, before[down], first[down])
    every = [x for c in range(256) for x in (larger[c], smaller[c]) if len(x)]
    return _joined(every), smaller


def _names(t: np.ndarray, starts: np.ndarray, ordered: np.ndarray, depth: int | None) -> tuple[np.ndarray, int]:
    """A name for each substring (in text order) that follows the order; equal substrings share one."""
    n, m = len(t), len(starts)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    total = np.concatenate([[np.uint64(0)], np.cumsum((t.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
    ends = np.minimum(np.append(starts[1:] + 1, n), n)
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))
    digest = (total[ends] - total[starts]) * back[starts]
    length = ends - starts
    length[-1] += 1  # the last reaches the end and equals no other
    rank = np.empty(n, np.int32)
    rank[starts] = np.arange(m, dtype=np.int32)
    o = rank[ordered]
    new = (digest[o][1:] != digest[o][:-1]) | (length[o][1:] != length[o][:-1])
    if depth is not None:
        reach = np.append(starts[1:] - starts[:-1], depth)
        new |= reach[o][1:] >= depth
    named = np.concatenate([[0], np.cumsum(new)])
    out = np.empty(m, np.int64)
    out[o] = named
    return out, int(named[-1]) + 1


def _sorted_names(names: np.ndarray, starts: np.ndarray, depth: int | None) -> np.ndarray:
    """The suffixes of the string of names in order: neighbouring names are named as pairs, and so on recursively."""
    m, k, rank = len(names), 1, names
    while True:
        pair = rank * np.int64(m + 1)
        pair[:-k] += rank[k:] + 1
        order = np.argsort(pair, kind="stable")
        new = pair[order][1:] != pair[order][:-1]
        if depth is not None:
            reach = np.full(m, depth)
            reach[: m - 2 * k] = starts[2 * k :] - starts[: m - 2 * k]
            new |= reach[order][1:] >= depth
        rank = np.empty(m, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(new)])
        k *= 2
        if new.all() or k >= m:
            return order


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of the suffixes of ``t`` (uint8) in order."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _smaller(t)
    starts = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(starts) < 2:
        return _induce(t, starts)[0]
    _, by_bucket = _induce(t, starts)
    leftmost = np.zeros(n, bool)
    leftmost[starts] = True
    ordered = _joined([x for x in by_bucket if len(x)])
    ordered = ordered[leftmost[ordered]]
    names, count = _names(t, starts, ordered, depth)
    if count < len(starts):
        order = _sorted_names(names, starts, depth)
    else:
        order = np.empty(len(starts), np.int64)
        order[names] = np.arange(len(starts))
    return _induce(t, starts[order])[0]


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int, of: np.ndarray | None = None) -> np.ndarray:
    """Permuted: for each suffix, in text order, how many characters, up to ``most``, it shares with the one before it in order.

    ``of``: the suffixes to look at, all by default; the others get 0.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([t, np.zeros(most + 16, np.uint8)])
    eight = np.ndarray((n + most + 8,), "<u8", buffer=padded, strides=(1,))
    out = np.zeros(n, np.int32)
    here = np.flatnonzero(before >= 0) if of is None else of[before[of] >= 0]
    for k in range(0, most, 8):
        x = eight[here + k] ^ eight[before[here] + k]
        # Equal bytes at the low end of the difference.
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        out[here] = k + same
        here = here[x == 0]
        if not len(here):
            break
    # Neither suffix reaches beyond the text.
    return np.minimum(np.minimum(out, most), n - np.maximum(np.arange(n), before)).astype(np.int32)
