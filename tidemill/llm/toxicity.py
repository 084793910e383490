"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

The gap-weighted kernel counts the subsequences of ``ORDER`` characters that two strings share, each weighted by
``DECAY`` for every character that it spans in either. Characters inserted into an insult and endings put behind it cost
a part of the value, no more. A word is a string with a mark before it, so that a beginning counts as one. Its features are
its kernel values with the landmarks, each over the landmark's own and to the power ``POWER`` (a product of string kernels
is one), whitened by the landmarks' kernel matrix (Nystroem). Neighbouring sentences are read in windows of
2 * ``HALF`` words, whose features are the sums of their words'; the document is as toxic as its worst window.

Landmarks are from both classes: words and beginnings of words that stand in toxic training documents far more often
than chance allows, chosen so that they differ, and the words of clean documents that are most like them. Training is on
the strongest window of each labelled document, chosen again by the machine in each round, since labels are for documents.
Training takes at most ``max_train_rows`` labelled rows, by a hash of their id; every document's whole text is scored in
one pass, without a shuffle. A worker keeps the features of the words it has seen, nearly all of which are ruled out by
character pairs before the kernel runs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept_by_worker, lean_batches, spread, written

MAX_TRAIN_ROWS = 12_000
#: Landmarks from toxic and from clean documents: the rank of the Nystroem map, not a limit on the words compared.
LANDMARKS = 40
CONTRASTS = 32
ORDER = 3
DECAY = 0.6
POWER = 4
#: A window's sum for one landmark counts no more than this.
MOST = 8.0
#: Log-likelihood gain from which a word marks toxic documents.
LEAST_GAIN = 9.0
#: Characters of a word that the kernel sees at once; longer words are seen in overlapping parts.
SPAN = 24
LONGEST_LANDMARK = 12
SHORTEST_LANDMARK = 4
#: Beginnings of up to so many letters are candidates, besides whole words.
LONGEST_BEGINNING = 7
#: Share of a landmark's neighbouring characters that a word must have in order, up to two characters apart.
SHARED_PAIRS = 0.7
#: Smaller features count as none: four characters of ten, or so.
FLOOR = 0.01
#: Landmarks have a smaller feature than this in each other.
APART = 0.4
#: Words whose features a worker keeps, twice.
CACHE = 120_000
#: Half the words of a window; windows overlap by half.
HALF = 100
START = "^"

_letters = re.compile(r"[^\W\d_]+").findall
#: Letters set apart by blanks or signs.
_apart = re.compile(r"(?<!\w)[^\W\d_](?:[\W_]{1,2}[^\W\d_](?!\w)){2,}").findall
_sentences = re.compile(r"[.!?\n]+(?=\s|$)").split
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…—–"


def cores(token: str) -> list[str]:
    """What a token between blanks is compared as: without signs around it; if signs or digits stand between its letters, its runs of letters and all its letters joined."""
    core = token.strip(_SIGNS)
    if core.isalpha():
        return [core]
    runs = _letters(core)
    return [*runs, "".join(runs)] if len(runs) > 1 else runs


def apart(text: str, tokens: set[str]) -> list[str]:
    """Words whose letters stand apart, joined."""
    if sum(len(t) == 1 for t in tokens) < 3 and not any(len(t.strip(_SIGNS)) == 1 for t in tokens if len(t) < 4):
        return []
    return ["".join(_letters(x)) for x in _apart(text)]


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The gap-weighted subsequence kernel of each row of s with the same row of t; codes below 1 match nothing."""
    n, width = t.shape
    gap = np.arange(width + 1)[None, :] - 1 - np.arange(width)[:, None]
    reach = np.where(gap >= 0, decay ** (np.maximum(gap, 0) + 2.0), 0.0)
    part = [np.ones((n, width + 1))] + [np.zeros((n, width + 1)) for _ in range(order - 1)]
    total = np.zeros(n)
    for a in range(s.shape[1]):
        same = (t == s[:, a : a + 1]) & (t > 0)
        if not same.any():
            for i in range(1, order):
                part[i] *= decay
            continue
        total += decay**2 * (same * part[order - 1][:, :width]).sum(1)
        for i in range(order - 1, 0, -1):
            part[i] = decay * part[i] + (same * part[i - 1][:, :width]) @ reach
    return total


@dataclass
class Landmarks:
    """Landmark words with what is needed to compare them fast."""

    words: list[str]

    def __post_init__(self):
        letters = sorted({c for w in self.words for c in START + w})
        self.table = np.zeros(max(map(ord, letters), default=0) + 2, np.uint8)
        for i, c in enumerate(letters):
            self.table[ord(c)] = i + 1
        self.codes = self.encode([START + w for w in self.words], LONGEST_LANDMARK)
        self.own = kernel(self.codes, self.codes) if self.words else np.zeros(0)
        n = len(letters) + 1
        pairs = sorted({(int(a), int(b)) for row in self.codes for a, b in zip(row[:-1], row[1:], strict=True) if a and b})
        self.pair_at = np.full(n * n, len(pairs), np.int32)
        for i, (a, b) in enumerate(pairs):
            self.pair_at[a * n + b] = i
        self.n = n
        self.needs = np.zeros((len(pairs) + 1, len(self.words)), np.float32)
        for j, row in enumerate(self.codes):
            for a, b in zip(row[:-1], row[1:], strict=True):
                if a and b:
                    self.needs[self.pair_at[int(a) * n + int(b)], j] = 1
        self.least = SHARED_PAIRS * self.needs.sum(0)

    def encode(self, words: list[str], width: int) -> np.ndarray:
        out = np.zeros((len(words), width), np.uint8)
        if words:
            flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            codes = self.table[np.minimum(flat, len(self.table) - 1)]
            codes[flat >= len(self.table)] = 0
            at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            row = np.repeat(np.arange(len(words)), lengths)
            fits = at < width
            out[row[fits], at[fits]] = codes[fits]
        return out

    def features(self, words: list[str]) -> np.ndarray:
        """Of each word with each landmark: kernel over the landmark's own value, 1 at most, to the power POWER; 0 if below FLOOR."""
        parts, owner = [], []
        for i, w in enumerate(words):
            w = START + w
            for k in range(0, max(1, len(w) - SPAN // 2), SPAN // 2):
                parts.append(w[k : k + SPAN])
                owner.append(i)
        out = np.zeros((len(words), len(self.words)))
        if not self.words:
            return out
        owner = np.array(owner, np.int64)
        for i in range(0, len(parts), 4096):
            s = self.encode(parts[i : i + 4096], SPAN)
            have = np.zeros((len(s), len(self.needs)), np.float32)
            rows = np.arange(len(s))[:, None]
            wide = s.astype(np.int32)
            for gap in (1, 2, 3):
                have[rows, self.pair_at[wide[:, :-gap] * self.n + wide[:, gap:]]] = 1
            have[:, -1] = 0
            w, j = np.nonzero(have @ self.needs >= self.least)
            for k in range(0, len(w), 8192):
                a, b = w[k : k + 8192], j[k : k + 8192]
                value = np.minimum(1.0, kernel(s[a], self.codes[b]) / self.own[b]) ** POWER
                np.maximum.at(out, (owner[i + a], b), np.where(value < FLOOR, 0.0, value))
        return out


class Reader:
    """Features of tokens, kept over the documents of a worker: None for nearly all."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.known: dict[str, np.ndarray | None] = {}
        self.older: dict[str, np.ndarray | None] = {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        new = tokens.difference(self.known)
        if self.older:
            seen = {t for t in new if t in self.older}
            self.known.update({t: self.older[t] for t in seen})
            new -= seen
        if not new:
            return
        parts = {t: cores(t) for t in new}
        words = list({c for found in parts.values() for c in found}.difference(self.known))
        self.known.update({w: self.older[w] for w in words if w in self.older})
        words = [w for w in words if w not in self.known]
        f = self.landmarks.features(words)
        self.known.update(dict.fromkeys(words))
        for i in np.flatnonzero(f.any(1)):
            self.known[words[i]] = f[i].astype("<f4")
        for t, found in parts.items():
            rows = [r for c in found if (r := self.known[c]) is not None]
            self.known[t] = None if not rows else rows[0] if len(rows) == 1 else np.max(rows, axis=0)

    def windows(self, text: str) -> np.ndarray:
        """Features of the document's windows that have any, a row for each. Words whose letters stand apart count in every window."""
        text = text.lower()
        words = text.split()
        tokens = set(words)
        joined = apart(text, tokens)
        self.learn(tokens | set(joined))
        known = self.known
        hits = {t: f for t in tokens if (f := known[t]) is not None}
        spaced = [f for j in joined if (f := known[j]) is not None]
        if not hits and not spaced:
            return np.zeros((0, len(self.landmarks.words)))
        sums: dict[int, np.ndarray] = {}
        for i, t in enumerate(words) if hits else ():
            if t in hits:
                half = i // HALF
                sums[half] = sums[half] + hits[t] if half in sums else hits[t]
        none = np.zeros(len(self.landmarks.words))
        rows = [sums.get(k, none) + sums.get(k + 1, none) for k in sorted({j for k in sums for j in (k - 1, k)})] or [none]
        return np.minimum(MOST, np.array(rows) + sum(spaced, none))


@dataclass
class Machine:
    landmarks: Landmarks
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, features: np.ndarray) -> np.ndarray:
        return features @ (self.whiten @ self.weights) + self.bias

    def probability(self, margin: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * margin + self.shift))))

    def score(self, reader: Reader, text: str | None) -> float:
        rows = reader.windows(text or "")
        return self.probability(max([self.bias, *self.margins(rows)]) if len(rows) else self.bias)


def _newton(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Squared-hinge support vector machine; the last column of x is the bias. y: -1 or 1, c: weight of each row."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        active = y * (x @ w) < 1
        a = x[active] * c[active, None]
        new = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and shift of a logistic curve of the margins."""
    x = np.stack([m, np.ones_like(m)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), x.T @ (y - p) - 0.05 * (w - [1.0, 0.0]))
        w = w + step
        if abs(step).max() < 1e-8:
            break
    return max(0.1, float(w[0])), float(w[1])


def _unlike(words: list[str], most: int) -> list[str]:
    """The first words, each unlike those taken before it."""
    marks = Landmarks(words)
    near = marks.features(words)
    near = np.maximum(near, near.T)
    taken: list[int] = []
    for i in range(len(words)):
        if len(taken) == most:
            break
        if not taken or near[i, taken].max() < APART:
            taken.append(i)
    return [words[i] for i in taken]


def choose_landmarks(toxic: list[str], clean: list[tuple[str, int]], most: int = LANDMARKS, contrasts: int = CONTRASTS) -> list[str]:
    """Of the words that mark toxic documents, best first, those unlike each other; then those of (clean word, documents) most like any of them."""
    chosen = _unlike(toxic, most) if toxic else []
    if not chosen or not clean:
        return chosen
    like = Landmarks(chosen).features([w for w, _ in clean]).max(1) * np.log1p([n for _, n in clean])
    nearest = [clean[i][0][: LONGEST_LANDMARK - 1] for i in np.argsort(-like, kind="stable")[: 20 * contrasts] if like[i] > 0]
    return [*chosen, *(w for w in _unlike(list(dict.fromkeys(nearest)), contrasts) if w not in chosen)]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by class with each word (``whole``), and with each beginning that can be a landmark."""
    for batch in batches:
        whole, part = (Counter(), Counter()), (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {c for t in set(text.lower().split()) for c in cores(t) if len(c) >= SHORTEST_LANDMARK}
            whole[1 if toxic else 0].update(words)
            part[1 if toxic else 0].update({w[:k] for w in words for k in (*range(SHORTEST_LANDMARK, min(len(w), LONGEST_BEGINNING + 1)), LONGEST_LANDMARK - 1)})
        for kind, counts in ((True, whole), (False, part)):
            every = list(counts[1].keys() | counts[0].keys())
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(every), pa.bool_()), pa.array(every, pa.string()), pa.array([counts[1][w] for w in every], pa.int64()), pa.array([counts[0][w] for w in every], pa.int64())], ["whole", "word", "toxic", "clean"])


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Machine:
    """From ``doc_id``, ``text`` and ``doc_id``, ``toxic``. Rows with a null id, text or label teach nothing; of several labels of an id the largest holds."""
    spark = docs.sparkSession
    lean_batches(spark)
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    share = 1.0 if n <= max_train_rows else max_train_rows / n
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About max_train_rows ids of 8 bytes, whatever the size of the corpus.
    rows = written(spread(docs.select("doc_id", "text")).where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-train")
    by_label = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, bad = sum(by_label.values()), by_label.get(1, 0)
    none = Machine(Landmarks([]), np.zeros((0, 0)), np.zeros(0), -1.0, 1.0, -2.0)
    if not bad or bad == total:
        return none
    counts = rows.mapInArrow(_word_counts, "whole boolean, word string, toxic long, clean long").groupBy("whole", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts, "toxic-words")
    base = bad / total
    share_toxic = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    # Log-likelihood gain of "its documents are toxic at their own rate" over "at the base rate".
    gain = F.col("toxic") * F.log(share_toxic / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share_toxic) / (1 - base))).otherwise(0.0)
    strong = counts.where(~F.col("whole") & (F.col("toxic") > 0)).where(share_toxic > base).withColumn("gain", F.round(gain, 6)).where(F.col("gain") > LEAST_GAIN)
    strong = strong.orderBy(F.desc("gain"), F.desc(F.length("word")), "word").limit(10 * LANDMARKS).collect()
    plain = counts.where(F.col("whole") & (F.col("clean") > 0)).orderBy(F.desc("clean"), "word").limit(500 * CONTRASTS).collect()
    marks = Landmarks(choose_landmarks([r["word"] for r in strong], [(r["word"], r["clean"]) for r in plain]))
    if not marks.words:
        return none
    sent = spark.sparkContext.broadcast(marks)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                found.append(np.unique(reader.windows(text), axis=0).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], ["toxic", "found"])

    seen = rows.mapInArrow(windows, "toxic int, found binary").collect()  # max_train_rows documents, a row of numbers for each HALF words
    m = len(marks.words)
    bags = [np.frombuffer(r["found"], "<f4").reshape(-1, m) if r["found"] else np.zeros((1, m), "<f4") for r in seen]
    y = np.array([1.0 if r["toxic"] else -1.0 for r in seen])
    gram = marks.features(marks.words)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-2))
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    pick = np.array([b[int(b.sum(1).argmax())] for b in bags], float)
    for _ in range(4):
        x = np.hstack([pick @ whiten, np.ones((len(pick), 1))])
        w = _newton(x, y, c)
        pick = np.array([b[int(np.argmax(b @ (whiten @ w[:-1])))] for b in bags], float)
    margins = np.maximum(pick @ (whiten @ w[:-1]) + w[-1], w[-1])
    slope, shift = _logistic(margins, (y > 0).astype(float))
    return Machine(marks, whiten, w[:-1], float(w[-1]), slope, shift)


def score(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of each row; null and empty texts get the score of a text without any word like a landmark.

    Equal texts get equal scores; an empty table gives no rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # LANDMARKS words and their weights

    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value.landmarks
        reader = kept_by_worker(("toxicity", *marks.words), lambda: Reader(marks))
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                s = [sent.value.score(reader, t) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s, pa.float64())], [*batch.schema.names[: len(keep)], "score"])

    left = docs.select(*keep) if at < len(keep) else docs.select(*keep, F.col(text).alias("text_"))
    schema = ", ".join(f"`{c}` {t}" for c, t in left.dtypes[: len(keep)])
    return spread(left).mapInArrow(run, f"{schema}, score double")
