"""Quality rules with cross-document line frequency.

One pass over the texts gives each document's base figures and its distinct normalised lines as 64-bit hashes of
(host, line). Distinct documents are counted by hash, with partial sums before the shuffle; lines in more documents of
a host than its limit are removed, and a document that loses more than ``depleted`` of its word characters is rejected.
The host of a document is its ``source``.

Scale: texts are read once and never shuffled; what is shuffled is 16 bytes a line. A line in a third of all documents is
summed in each task first, and the join that follows has rows to split where its key is hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, lean_batches, spread, written

#: A line is removed if more of a host's documents hold it than this share of them, and than LEAST_LIMIT: a line that two
#: or three documents have in common says nothing about a host, however small.
LIMIT_SHARE = 0.02
LEAST_LIMIT = 3
#: A document is rejected if more than this share of its word characters goes.
DEPLETED = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
WINDOW = 5

_words = re.compile(WORD).findall
_digits = re.compile("[0-9]+").sub
_BLANK = " \t\n\x0b\x0c\r"
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_window_words(words: list[str]) -> int:
    """Words that lie in a window of five words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    g = h[:n] * _MIX[0]
    for k in range(1, WINDOW):
        g += h[k : k + n] * _MIX[k]
        g ^= g >> np.uint64(29)
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def normalised(line: str) -> str:
    """Outer blanks off, lower case, each run of digits as 0."""
    return _digits("0", line.strip(_BLANK).lower())


def line_hash(host: str | None, line: str) -> int:
    h = xxhash.xxh64_intdigest(f"{'=' + host if host is not None else ''}\n{normalised(line)}")
    return h - (1 << 64) if h >> 63 else h


def base_figures(text: str) -> tuple[int, int, int, int, int]:
    words = _words(text)
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_window_words(words)


def _line_sizes(host: str | None, text: str) -> dict[int, int]:
    sizes: dict[int, int] = {}
    for line in text.split("\n"):
        if chars := len(line) - sum(map(line.count, _BLANK)):
            h = line_hash(host, line)
            sizes[h] = sizes.get(h, 0) + chars
    return sizes


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 33
    for batch in batches:
        ids, texts, hosts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        figures, hashes, chars, ends = [], [], [], [0]
        for text, host in zip(texts, hosts, strict=True):
            figures.append(base_figures(text or ""))
            sizes = _line_sizes(host, text or "")
            hashes.extend(sizes)
            chars.extend(sizes.values())
            ends.append(len(hashes))
        columns = [pa.array(c, pa.int64()) for c in zip(*figures, strict=True)] if figures else [pa.array([], pa.int64())] * 5
        offsets = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((hashes, pa.int64()), (chars, pa.int32()))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(uid, uid + len(texts))), ids, batch.column(2), *columns, *lists],
            ["uid", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hashes", "line_chars"],
        )
        uid += len(texts)


def frequent_lines(scanned: DataFrame, limit_share: float = LIMIT_SHARE, least_limit: int = LEAST_LIMIT) -> DataFrame:
    """``hash`` of each line that more of its host's documents hold than the host's limit."""
    limits = scanned.groupBy("host").agg(F.greatest(F.lit(least_limit), F.ceil(F.count(F.lit(1)) * F.lit(limit_share))).alias("most"))
    counts = scanned.select("host", F.explode("line_hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least_limit)
    return counts.join(limits, counts["host"].eqNullSafe(limits["host"])).where("n > most").select("hash")


def quality(docs: DataFrame, limit_share: float = LIMIT_SHARE, least_limit: int = LEAST_LIMIT, depleted: float = DEPLETED) -> DataFrame:
    """One row per document: ``uid``, ``doc_id``, ``host``, the five figures, ``removed_chars``, ``base_failed``, ``kept``.

    A null text counts as empty and fails the base rules; a null source is a host of its own; equal rows count as
    different documents; an empty table gives no rows; only ``doc_id``, ``text`` and ``source`` are read.
    """
    lean_batches(docs.sparkSession)
    scanned = written(spread(docs.select(F.col("doc_id").cast("long"), "text", F.col("source").alias("host"))).mapInArrow(_scan, f"uid long, doc_id long, host string, {METRICS}, line_hashes array<long>, line_chars array<int>"), "quality-scan")
    doomed = written(frequent_lines(scanned, limit_share, least_limit), "quality-lines")
    lines = scanned.select("uid", F.explode(F.arrays_zip("line_hashes", "line_chars")).alias("l")).select("uid", F.col("l.line_hashes").alias("hash"), F.col("l.line_chars").alias("chars"))
    lost = lines.join(doomed, "hash").groupBy("uid").agg(F.sum("chars").alias("removed_chars"))
    judged = scanned.drop("line_hashes", "line_chars").join(lost, "uid", "left").withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("removed_chars") <= F.col("word_chars") * F.lit(depleted)))


def without_frequent_lines(docs: DataFrame, limit_share: float = LIMIT_SHARE, least_limit: int = LEAST_LIMIT) -> DataFrame:
    """``docs`` (``doc_id``, ``source``) with the frequent lines taken out of ``text``; blank lines stay."""
    split = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("uid"))
    split = written(split, "quality-texts")
    scanned = written(split.select("doc_id", "text", F.col("source").alias("host")).mapInArrow(_scan, f"uid long, doc_id long, host string, {METRICS}, line_hashes array<long>, line_chars array<int>"), "quality-scan")
    doomed = written(frequent_lines(scanned, limit_share, least_limit), "quality-lines")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, host, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                lines = (text or "").split("\n")
                keys = [line_hash(host, x) if x.strip(_BLANK) else None for x in lines]
                yield pa.RecordBatch.from_arrays([pa.array([uid] * len(lines), pa.int64()), pa.array(range(len(lines)), pa.int32()), pa.array(keys, pa.int64()), pa.array(lines, pa.string())], ["uid", "at", "hash", "line"])

    lines = split.select("uid", "source", "text").mapInArrow(hashed, "uid long, at int, hash long, line string")
    left = lines.join(doomed.distinct(), "hash", "left_anti").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("kept"))
    return split.join(left, "uid", "left").select("doc_id", "source", F.when(F.col("text").isNotNull(), F.coalesce(F.array_join("kept.line", "\n"), F.lit(""))).alias("text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM t) GROUP BY doc_id),
l AS (SELECT doc_id, source, line, regexp_replace(lower(trim(line, E' \t\n\x0b\x0c\r')), '[0-9]+', '0', 'g') AS norm,
             length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
      FROM (SELECT doc_id, source, unnest(string_split(text, E'\n')) AS line FROM d)),
n AS (SELECT * FROM l WHERE chars > 0),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM n GROUP BY doc_id),
m AS (SELECT source, greatest(3, ceil(count(*) * 0.02)) AS most FROM d GROUP BY source),
f AS (SELECT n.source, norm FROM n JOIN m ON n.source IS NOT DISTINCT FROM m.source GROUP BY n.source, norm, most HAVING count(DISTINCT doc_id) > most),
x AS (SELECT doc_id, sum(chars) AS gone FROM n JOIN f ON n.source IS NOT DISTINCT FROM f.source AND n.norm = f.norm GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0) AS gone
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND gone <= 0.5 * word_chars AS kept
FROM b
"""
