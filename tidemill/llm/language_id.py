"""Language identification, word-first with backoff to character n-grams.

A word that the model knows adds its log frequency in each language. An unseen word backs off: its known character
n-grams of five, else four, three, two, one characters stand in for it, with a smaller weight at each step.

The model is fitted on at most ``max_train_rows`` rows with a language (chosen by a hash of their id), and holds each
language's ``max_words`` most frequent words and as many n-grams, so that a small language keeps its own vocabulary
beside a large one and the model is a few MB for each language at any corpus size. N-grams are counted from the table of
distinct words. Every document is predicted, over its whole text, in one pass without a shuffle; a worker keeps the
model and the words that it has met.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept_by_worker, lean_batches, spread, written

MAX_TRAIN_ROWS = 12_000
#: Words, and n-grams, of each language.
MAX_WORDS = 20_000
LONGEST = 5
#: Weight of an n-gram estimate, for each step of the backoff.
BACKOFF = 0.7
#: Unseen words whose estimates a worker keeps.
CACHE = 200_000

_letters = re.compile(r"[^\W\d_]+").findall


def units(text: str) -> list[str]:
    """Runs of letters in lower case. Numbers that the pattern takes for letters, such as \u00b2 and \u00bd, are none."""
    words = _letters(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split()]


def grams(word: str, n: int) -> list[str]:
    padded = f"\x02{word}\x03"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, Counter()).update(units(text or ""))
        yield from _rows(by_lang)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, Counter] = {}
        for word, lang, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            pieces = by_lang.setdefault(lang, Counter())
            for n in range(1, LONGEST + 1):
                for g in grams(word, n):
                    pieces[g] += times
        yield from _rows(by_lang)


def _rows(by_lang: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, counts in by_lang.items():
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([lang] * len(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["unit", "lang", "n"])


class Model:
    """Centred log frequencies: ``index[kind][unit]`` is a row of ``rows``, a column for each language."""

    def __init__(self, langs: list[str], counts: dict[str, dict[str, dict[str, int]]]):
        self.langs = langs
        self.index: dict[str, dict[str, int]] = {}
        rows = []
        for kind, table in counts.items():
            self.index[kind] = {}
            if not table:
                continue
            raw = np.array([[c.get(lang, 0) for lang in langs] for c in table.values()], float).reshape(-1, len(langs))
            logs = np.log((raw + 0.5) / (raw.sum(0) + 0.5 * max(1, len(table))))
            self.index[kind] = {u: len(rows) + i for i, u in enumerate(table)}
            rows.extend(logs - logs.mean(1, keepdims=True))
        self.rows = np.array(rows) if rows else np.zeros((0, len(langs)))

    def unseen(self, word: str) -> np.ndarray:
        weight, known = 1.0, self.index.get("g", {})
        for n in range(LONGEST, 0, -1):
            weight *= BACKOFF
            if found := [known[g] for g in grams(word, n) if g in known]:
                return self.rows[found].mean(0) * weight
        return np.zeros(len(self.langs))


class Predictor:
    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.at = dict(self.model.index.get("w", {}))
        self.rows = np.zeros((len(self.model.rows) + CACHE, len(self.model.langs)))
        self.rows[: len(self.model.rows)] = self.model.rows
        self.free = len(self.model.rows)

    def learn(self, word: str) -> int:
        if self.free == len(self.rows):
            self.reset()
        self.rows[self.free] = self.model.unseen(word)
        self.at[word] = self.free
        self.free += 1
        return self.free - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the evidence; ``und`` if there is no letter or no language to choose from."""
        words = units(text or "")
        if not words or not self.model.langs:
            return "und", 0.0
        total = np.zeros(len(self.model.langs))
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            if self.free + len(part) > len(self.rows):
                self.reset()
            at = [self.at.get(w, -1) for w in part]
            if -1 in at:
                at = [self.at[w] if w in self.at else self.learn(w) for w in part]
            total += self.rows[at].sum(0)
        e = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.langs[best], float(e[best] / e.sum())


def train(rows: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, max_words: int = MAX_WORDS) -> Model:
    """From ``doc_id``, ``text``, ``lang``; rows without a text or language teach nothing."""
    lean_batches(rows.sparkSession)
    rows = rows.where("text is not null and lang is not null")
    n = rows.count()
    share = 1.0 if n <= max_train_rows else max_train_rows / n
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < int(share * (1 << 30)))
    summed = lambda counted: counted.groupBy("unit", "lang").agg(F.sum("n").alias("n"))
    words = written(summed(spread(chosen.select("text", "lang")).mapInArrow(_count, "unit string, lang string, n long")), "language-words")
    pieces = written(summed(words.mapInArrow(_count_grams, "unit string, lang string, n long")), "language-grams")
    falling = Window.partitionBy("lang").orderBy(F.desc("n"))

    def table(counted: DataFrame) -> dict[str, dict[str, int]]:
        """The units that are among the first of any language, with their counts in all.

        The count at which a language's units are ``max_words`` at most is found from how many units have each count, so no
        language's units are sorted in one task; units of equal count go in together or not at all.
        """
        by_count = counted.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("units")).withColumn("so_far", F.sum("units").over(falling))
        least = by_count.where(F.col("so_far") <= max_words).groupBy("lang").agg(F.min("n").alias("least"))
        first = counted.join(least, "lang").where("n >= least").select("unit").distinct()
        found: dict[str, dict[str, int]] = {}
        for r in counted.join(first, "unit", "left_semi").orderBy("unit", "lang").toLocalIterator():  # max_words times languages
            found.setdefault(r.unit, {})[r.lang] = r.n
        return found

    tables = {"w": table(words), "g": table(pieces)}
    langs = sorted({lang for t in tables.values() for c in t.values() for lang in c})
    return Model(langs, tables)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` for each row. Null texts and texts without a letter are ``und`` with score 0.

    Equal rows get equal results; an empty table gives none; other columns are not read. A model that learned from no
    rows says ``und``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # max_words words and n-grams of each language
    label = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = kept_by_worker(("language", label), lambda: Predictor(sent.value))
        for batch in batches:
            found = [predictor.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    left = docs.select(*keep, F.col(text).alias("text_"))
    schema = ", ".join(f"`{c}` {t}" for c, t in left.dtypes[:-1])
    return spread(left).mapInArrow(run, f"{schema}, lang_pred string, score double")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n
