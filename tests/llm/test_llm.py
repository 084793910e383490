"""Each operator against a brute-force version or held-out figures, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemill.llm import components, embedding_dedup, language_id, mixing, packing, quality_rules, queries, sharding, simhash, suffix_arrays, suffix_dedup, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, part long, size string, uid string"
LONG = "abcde fghij " * 4000
ROWS = [
    (1, "a b c d e f g h i j k " * 6, "en", "s", 1), (1, "a b c d e f g h i j k " * 6, "en", "s", 1), (2, "a b c d e f g h i j k " * 6, "en", None, 1), (3, None, None, "s", None), (None, "x" * 120, "en", "s", 1),
    (4, "", "de", "t", 0), (5, LONG, "en", "s", 1), (6, LONG + "tail", None, "t", 1), (7, "   \n\t ", "fr", "s", 1), (8, "été où ñandú İΣ 你好", "fr", "s", 1), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "f", 9, "z", "u") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, data):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(same, name):
    same(queries.QUERIES[name], queries.ORACLES[name])


# -- packing


def _packed(rows, texts, blocks=1):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    by, places = {}, {}
    for r in rows:
        by.setdefault(r.uid, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = Counter((d, tuple(t.encode(x or "", add_special_tokens=False).ids + [packing.END_ID])) for d, x in texts)
    got = Counter()
    for pieces in by.values():
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        got[pieces[0].doc_id, tuple(i for p in pieces for i in p.ids)] += 1
    assert got == want
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == list(np.cumsum([0] + [n for _, n in p])[:-1]) and sum(n for _, n in p) <= packing.WINDOW
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // packing.WINDOW) + blocks  # one padded sequence in each block


def test_packing_round_trip(spark, data, docs):
    _packed(packing.pack(spark.read.parquet(f"{data}/documents.parquet")).collect(), docs)


def test_packing_in_several_blocks(spark, data, docs):
    _packed(packing.pack(spark.read.parquet(f"{data}/documents.parquet"), block_tokens=1).collect(), docs, -(-len(docs) // 256))
    twice = [(d + 1000 * k, t) for k in range(3) for d, t in docs]
    rows = spark.createDataFrame(twice, "doc_id long, text string").coalesce(1)
    _packed(packing.pack(rows, block_tokens=50_000).collect(), twice, 8)


def test_packing_awkward(awkward, none, tmp_path):
    awkward.write.parquet(str(tmp_path / "awkward"))
    _packed(packing.pack(awkward.sparkSession.read.parquet(str(tmp_path / "awkward"))).collect(), [(r[0], r[1]) for r in ROWS])
    _packed(packing.pack(awkward).collect(), [(r[0], r[1]) for r in ROWS], awkward.rdd.getNumPartitions())
    assert packing.pack(none).count() == 0


def test_word_ids_are_the_tokenizers(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 300)  # words fall out and come back
    draw = random.Random(1)
    texts = ["".join(draw.choices("abcdefgHIJKéßÀ¿1234 '.,!\n\t  <|>", k=draw.randint(0, 200))) for _ in range(1500)]
    texts += ["", "<|endoftext|> a", "don't we're İ ẞ ﬁ é", "日本 x", "a\u00a0b", "e\u0301", *texts[:50]]
    ours = packing.WordTokenizer(public_tokenizers.path(packing.VOCABULARY))
    for text, ids in zip(texts, ours(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == ours.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_crc(spark, data):
    pieces = packing.pack(spark.read.parquet(f"{data}/documents.parquet").limit(5))
    one = {(r.uid, r.start): r.ids for r in pieces.collect()}
    assert all(zlib.crc32(np.array(one[r.uid, r.start], "<u4").tobytes()) == r.ids_crc32 for r in packing.with_crc32(pieces).collect())
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert sorted(packing.pack(docs, digest=True).collect()) == sorted(packing.with_crc32(packing.pack(docs)).collect())


def test_plan_uses_every_piece_once():
    counts = {n: 1 + n % 7 for n in range(1, 2048, 3)}
    layout = packing.plan(counts)
    assert layout.sequences == -(-sum(n * c for n, c in counts.items()) // 2048)


# -- toxicity, language


def test_kernel_is_the_sum_over_subsequences():
    from itertools import combinations

    def brute(s, t, p=3, d=0.6):
        f = lambda x: [("".join(x[i] for i in c), d ** (c[-1] - c[0] + 1)) for c in combinations(range(len(x)), p)]
        return sum(a * b for u, a in f(s) for v, b in f(t) if u == v)

    marks = toxicity.Landmarks(["idiot", "clown"])
    for w in ("idiot", "id*iot", "iddioot", "tniodi", "xx"):
        s = marks.encode(["^" + w], toxicity.SPAN)
        assert toxicity.kernel(s, marks.codes[:1])[0] == pytest.approx(brute([c if c in "^idiotclwn" else f"?{i}" for i, c in enumerate("^" + w)], list("^idiot")))


def _brute_score(machine, text):
    """A text's score by the definition: all windows, all words, all landmarks, the kernel as a sum over subsequences."""
    from itertools import combinations

    known = {}

    def subsequences(x):
        if x not in known:
            known[x] = Counter()
            for c in combinations(range(len(x)), toxicity.ORDER):
                known[x]["".join(x[i] for i in c)] += toxicity.DECAY ** (c[-1] - c[0] + 1)
        return known[x]

    def features(word):
        out = []
        for mark in machine.landmarks.words:
            m = subsequences("^" + mark)
            own = sum(v * v for v in m.values())
            parts = [("^" + word)[k : k + toxicity.SPAN] for k in range(0, max(1, len(word) + 1 - toxicity.SPAN // 2), toxicity.SPAN // 2)]
            out.append(max(min(1.0, sum(v * m[u] for u, v in subsequences(p).items() if u in m) / own) ** toxicity.POWER for p in parts))
        # What the operator leaves out: small features, and words with too few of a landmark's neighbouring characters.
        seen = machine.landmarks.features([word])[0]
        out = np.array(out)
        assert np.allclose(seen[seen > 0], out[seen > 0]) and out[seen == 0].max(initial=0) < 0.3
        return seen

    words = (text or "").lower().split()
    rows = [np.max([features(c) for c in toxicity.cores(w)] or [np.zeros(len(machine.landmarks.words))], axis=0) for w in words]
    halves = [np.sum(rows[i : i + toxicity.HALF], axis=0) for i in range(0, len(rows), toxicity.HALF)]
    windows = [halves[0], *(a + b for a, b in zip(halves, halves[1:], strict=False)), halves[-1]] if halves else []
    margins = [machine.bias, *(float(np.minimum(toxicity.MOST, w) @ (machine.whiten @ machine.weights)) + machine.bias for w in windows if w.any())]
    return machine.probability(max(margins))


def test_toxicity_by_brute_force(spark):
    """Scores of 300 sentences and of texts of several windows, with insults that have gaps, signs and insertions."""
    rows = _labelled(spark)
    machine = toxicity.train(rows.where("doc_id < 400"), rows)
    texts = [(r.doc_id, r.text) for r in rows.where("doc_id >= 300").collect()] + [(1000, "ra tion el " * 90 + "grumxbok fizlump " + "ou in st " * 120), (1001, "gr*umbok " * 3), (1002, None), (1003, ""), (1004, "grumbokfizlumpgrumbokfizlumpgrumbok")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), machine).collect()}
    assert got == {d: pytest.approx(_brute_score(machine, t), abs=1e-9) for d, t in texts}
    assert min(got[1000], got[1001], got[1004]) > 0.5


def _labelled(spark, n=600):
    dice = random.Random(3)
    word = lambda: "".join(dice.choice(["ra", "tion", "el", "ou", "in", "st", "ea"]) for _ in range(dice.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(dice.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            bad = dice.choice(["grumbok", "fizlump", "grum-bok", "fizzlump", "grumbokish"])
            words.insert(dice.randrange(len(words)), bad)
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_held_out(spark):
    rows = _labelled(spark)
    machine = toxicity.train(rows.where("doc_id < 400"), rows)
    got = toxicity.score(rows.where("doc_id >= 400"), machine, keep=("doc_id", "toxic")).collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in got) >= 0.97 * len(got)
    extra = spark.createDataFrame([(1, "you g.r.u.m.b.o.k there"), (2, "you g r u m b o k there"), (3, "a nice el in"), (4, None), (5, "")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(extra, machine).collect()}
    assert min(s[1], s[2]) > 0.5 > max(s[3], s[4], s[5]) and s[4] == s[5]


def test_toxicity_awkward_rows_of_a_trained_machine(spark, awkward):
    rows = _labelled(spark)
    machine = toxicity.train(rows, rows)
    got = toxicity.score(awkward, machine, keep=("doc_id", "text")).collect()
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, set()).add(r.score)
    assert len(got) == len(ROWS) and all(len(x) == 1 for x in by_text.values()) and by_text[None] == by_text[""]
    long = spark.createDataFrame([(1, "el ou " * 30_000 + "grumbok fizlump grumbok"), (2, "el ou " * 30_000)], "doc_id long, text string")
    a, b = (r.score for r in toxicity.score(long, machine).orderBy("doc_id").collect())
    assert a > 0.5 > b


def test_toxicity_awkward(spark, awkward, none):
    machine = toxicity.train(none, none.select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.score(awkward, machine).count() == len(ROWS) and toxicity.score(none, machine).count() == 0


def test_language(spark, data, awkward, none):
    got = queries.op7_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert language_id.units("Ab\u00b2c \u00bd \u2460 d3\u00e9 I\u0130") == ["ab", "c", "d", "\u00e9", *language_id.units("I\u0130")]
    signs = spark.createDataFrame([(1, "\u00b2 \u00bd \u2460 12 _"), (2, "a")], "doc_id long, text string")
    model = language_id.train(spark.createDataFrame([(1, "a b", "en"), (2, "c d", "de")], "doc_id long, text string, lang string"))
    assert [(r.doc_id, r.lang_pred) for r in language_id.predict(signs, model).orderBy("doc_id").collect()] == [(1, "und"), (2, "en")]
    few = spark.createDataFrame([(1, "aa aa aa bb bb cc dd", "en")], "doc_id long, text string, lang string")
    assert set(language_id.train(few, max_words=3).index["w"]) == {"aa", "bb"}  # cc and dd do not both fit
    model = language_id.train(awkward)
    rows = language_id.predict(awkward, model, keep=("doc_id", "text")).collect()
    assert len(rows) == len(ROWS) and all(r.lang_pred == "und" for r in rows if not r.text or not r.text.strip())
    assert language_id.predict(none, language_id.train(none)).count() == 0


def test_language_by_brute_force(spark, data):
    """Predictions from plain dictionaries: counts of training words and n-grams, sums of centred logs."""
    import math

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()
    teach = [(r.text, r.lang) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.text is not None and r.lang is not None]
    tables = {"w": {}, "g": {}}
    for text, lang in teach:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for kind, units in (("w", [w]), ("g", [g for n in range(1, 6) for g in language_id.grams(w, n)])):
                for u in units:
                    tables[kind].setdefault(u, Counter())[lang] += 1
    langs = sorted({lang for _, lang in teach})
    for kind, table in tables.items():
        kept = set()
        for lang in langs:
            with_count = Counter(table[u][lang] for u in table if table[u][lang])
            fits = [n for n in with_count if sum(c for m, c in with_count.items() if m >= n) <= language_id.MAX_WORDS]
            kept |= {u for u in table if fits and table[u][lang] >= min(fits)}
        total = {lang: sum(table[u][lang] for u in kept) for lang in langs}
        for u in list(table):
            if u not in kept:
                del table[u]
                continue
            logs = [math.log((table[u][lang] + 0.5) / (total[lang] + 0.5 * len(kept))) for lang in langs]
            table[u] = [x - sum(logs) / len(logs) for x in logs]

    def predicted(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words:
            return "und", 0.0
        sums = [0.0] * len(langs)
        for w in words:
            row, weight = tables["w"].get(w), 1.0
            for n in range(5, 0, -1):
                if row is not None:
                    break
                weight *= language_id.BACKOFF
                if found := [tables["g"][g] for g in language_id.grams(w, n) if g in tables["g"]]:
                    row = [weight * sum(c) / len(found) for c in zip(*found, strict=True)]
            sums = [a + b for a, b in zip(sums, row or [0.0] * len(langs), strict=True)]
        e = [math.exp(x - max(sums)) for x in sums]
        return langs[sums.index(max(sums))], max(e) / sum(e)

    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op7_language_id(spark, data).collect()}
    for r in docs:
        lang, score = predicted(r.text)
        assert got[r.doc_id] == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1, lang, pytest.approx(score, abs=1e-6))


# -- repeated passages


def test_suffix_array_and_prefixes():
    dice = random.Random(1)
    for _ in range(150):
        s = bytes(dice.choice(dice.choice([b"ab", b"a", b"abcd\xff"])) for _ in range(dice.choice([1, 2, 7, 60, 400])))
        t = np.frombuffer(s, np.uint8)
        order = suffix_arrays.suffix_array(t)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        near = [s[i : i + 6] for i in suffix_arrays.suffix_array(t, depth=6)]
        assert near == sorted(near)
        shared = suffix_arrays.common_prefixes(t, order, 50)
        for a, b in zip(order, order[1:], strict=False):
            n = next((k for k in range(50) if a + k >= len(s) or b + k >= len(s) or s[a + k] != s[b + k]), 50)
            assert shared[b] == n


def _repeats(rows):
    """(n_bytes, removed spans, sha256 of the rest) of each row, by the definition."""
    first, out = {}, []
    key = lambda d: (d is None, d or 0)
    grams = [{(t or "").encode()[i : i + 50] for i in range(len((t or "").encode()) - 49)} for _, t in rows]
    for (d, _), g in zip(rows, grams, strict=True):
        for x in g:
            first[x] = min(first.get(x, key(d)), key(d))
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key(d):
                gone[i : i + 50] = b"\1" * 50
        spans = [(m.start(), m.end() - m.start()) for m in re.finditer(b"\1+", gone)]
        out.append((d, len(b), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


def _found(df):
    return sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], hashlib.sha256(r.kept_bytes).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect()), key=str)


def test_suffix_dedup_by_definition(spark, data, docs):
    assert _found(spark.read.parquet(f"{data}/documents.parquet")) == _repeats(docs)


def test_suffix_dedup_awkward(awkward, none):
    assert _found(awkward) == _repeats([(r[0], r[1]) for r in ROWS])
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_of_hot_keys(spark, data, docs, awkward, monkeypatch):
    """The same spans where every shared key is hot and its windows are dealt out one by one."""
    hot = spark.sparkContext.accumulator(0)

    def all_hot(t):
        # Set where the key is answered, in the worker, and put back for the tests that come after.
        from tidemill.llm import suffix_dedup as there

        before, there.HOT = there.HOT, 0
        try:
            out = there._answer_keys(t)
        finally:
            there.HOT = before
        hot.add(sum(np.count_nonzero(np.frombuffer(there._unpacked(a), np.uint8) == 2) for a in out.column("answer").to_pylist()))
        return out

    monkeypatch.setattr(suffix_dedup, "_answer_keys", all_hot)
    assert _found(awkward) == _repeats([(r[0], r[1]) for r in ROWS])
    assert _found(spark.read.parquet(f"{data}/documents.parquet")) == _repeats(docs)
    assert hot.value > 0
    # Many parts, whose entries meet before the windows' shards get them.
    monkeypatch.setattr(suffix_dedup, "PARTS_MET", 1)
    monkeypatch.setattr(suffix_dedup, "spread", lambda df: df.repartition(5))
    assert _found(awkward) == _repeats([(r[0], r[1]) for r in ROWS])
    assert _found(spark.read.parquet(f"{data}/documents.parquet")) == _repeats(docs)


# -- near duplicates


def test_simhash_by_definition(spark, data, docs, awkward, none):
    import xxhash

    def print_of(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [print_of(t) for _, t in docs]
    edges = [(docs[i][0], docs[j][0]) for i in range(len(docs)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    root = {b: a for a, b in components.forest(edges)}
    got = {r.doc_id: (int(r.fp) % (1 << 64), r.component_id) for r in simhash.near_duplicates(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert got == {d: (f, root.get(d, d)) for (d, _), f in zip(docs, fp, strict=True)}
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(ROWS) and {r.component_id for r in rows if r.fp == 0} == {3}
    assert simhash.near_duplicates(none).count() == 0


def test_links_at_three_bits(spark):
    dice = random.Random(5)
    base = [dice.getrandbits(64) for _ in range(50)]
    near = [b ^ sum(1 << i for i in dice.sample(range(64), k)) for b in base for k in (1, 2, 3, 4)]
    every = np.array(base + near, np.uint64)
    t = simhash._emit(16)
    import pyarrow as pa

    rows = pa.Table.from_batches(list(t(iter([pa.RecordBatch.from_arrays([pa.array(every.view(np.int64))], ["fp"])]))))
    found = []
    for b in range(16):
        out = simhash._meet(rows.filter(pa.compute.equal(rows["bucket"], b)))
        found += list(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))
    ints = [int(x) for x in every.view(np.int64)]
    want = components.forest([(a, b) for a in ints for b in ints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
    assert sorted(components.forest(found)) == sorted(want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long").repartition(7)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_raise_where_they_have_not_settled(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(40)
    with pytest.raises(RuntimeError):
        components.components(chain, most_rounds=1)


def test_vectors_of_any_magnitude(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [5e-324, 1e-323]), (4, [1.0, -2.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_vectors_awkward(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (3, [2.0, 4.0, 6.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 1.0]), (7, [float("nan"), 1.0, 1.0]), (8, [-1.0, 2.0, 0.5]), (8, [1.0, 2.0]), (None, v)]
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    alone = lambda i: (i, 0, i, True)
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (None, 3, 1, False), *map(alone, (4, 5, 6, 7, 8, 8))], key=str)
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def _crowd():
    """Vectors, all distinct: a group of 900 that all link, a chain whose ends do not, 150 pairs, 600 alone."""
    dice = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    off = lambda x, by: unit(unit(x) + by * unit(dice.standard_normal(x.shape)))
    centre, pairs = dice.standard_normal((1, 64)), dice.standard_normal((150, 64))
    group = off(np.repeat(centre, 900, 0), 0.05)
    one, two = np.eye(64)[:1], np.eye(64)[1:2]
    chain = np.concatenate([np.cos(0.25 * k) * one + np.sin(0.25 * k) * two for k in range(4)])
    return np.concatenate([chain, group, pairs, off(pairs, 0.25), dice.standard_normal((600, 64))]).astype("<f4")


def _links(x):
    """(n_links, component_id) of each row, by brute force."""
    x = x.astype(np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = x @ x.T >= embedding_dedup.THRESHOLD
    np.fill_diagonal(near, False)
    root = {b: a for a, b in components.forest(np.argwhere(near).tolist())}
    return {i: (int(n), root.get(i, i)) for i, n in enumerate(near.sum(1))}


def _vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_audit_only_measures(spark, monkeypatch):
    """A pair that only the audit names (the ends of a chain, which do not link) is no link."""

    def planted(nodes, kind, threshold):
        ends = nodes.where(F.col("vec").isin([bytearray(x[0].tobytes()), bytearray(x[3].tobytes())])).agg(F.min("node").alias("a"), F.max("node").alias("b"))
        return ends.select("a", "b", F.lit(0.99).alias("sim"))

    x = _crowd()[:12]
    monkeypatch.setattr(embedding_dedup, "audit", planted)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(_vectors(spark, x)).collect()}
    assert got == _links(x)


def test_vectors_by_brute_force(spark):
    """Far more vectors than the audit compares: each count and each group is exact."""
    x = _crowd()
    assert len(x) > 3 * embedding_dedup.AUDITED
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(_vectors(spark, x)).collect()}
    assert got == _links(x)


def test_descent_goes_on_below_its_recall(spark, monkeypatch):
    """Orders that find nothing at first: what is found later is returned, not what was found in time."""
    turns, real = [], embedding_dedup.first_graph

    def late(nodes, kind, seed, *rest):
        turns.append(seed)
        return real(nodes, kind, seed, *rest).where(F.lit(len(turns) > 4))

    x = _crowd()[:12]
    monkeypatch.setattr(embedding_dedup, "first_graph", late)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(_vectors(spark, x)).collect()}
    assert got == _links(x) and len(set(turns)) == len(turns)


def test_link_counts_by_blocks(spark):
    x = _crowd()[4:904]
    rows = [(i, 0, bytearray(v.tobytes()), 1 + i % 3) for i, v in enumerate(x)]
    got = {r.node: r.others for r in embedding_dedup.count_links(spark.createDataFrame(rows, "node long, root long, vec binary, copies long"), "<f4", chunk=100).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= embedding_dedup.THRESHOLD
    np.fill_diagonal(near, False)
    assert got == dict(enumerate((near @ np.array([r[3] for r in rows])).tolist()))


# -- native operators, quality


def _drawn(spark, quotas, shards, seed):
    rows = spark.createDataFrame(list(quotas.items()), "source_key string, quota long")
    return [tuple(r) for r in mixing.draw_blocks(rows, shards, seed).collect()]


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_tree_splits_quotas_exactly(spark, shards):
    quotas = {"a": 170, "b": 0, "c": 1010, "d": 5, "e": 1}
    drawn = _drawn(spark, quotas, shards, 1)
    assert sorted((k, n) for k, n, _ in drawn) == sorted((k, n) for k, q in quotas.items() for n in range(q))  # disjoint, and all of it
    rows = Counter(s for _, _, s in drawn)
    assert sorted(rows) == list(range(shards)) and max(rows.values()) - min(rows.values()) <= 5
    assert drawn == _drawn(spark, quotas, shards, 1) or sorted(drawn) == sorted(_drawn(spark, quotas, shards, 1))
    if shards > 1:
        assert sorted(drawn) != sorted(_drawn(spark, quotas, shards, 2))
        # No shard has a run of a source's blocks: neighbours go to different shards about as often as chance has it.
        of = {n: s for k, n, s in drawn if k == "c"}
        same = sum(of[n] == of[n + 1] for n in range(1009)) / 1009
        assert abs(same - 1 / shards) < 0.06


def test_draws_are_hypergeometric(spark):
    """Over many trees the blocks of a source in a shard have the mean and variance of a draw without replacement."""
    quotas, shards = {"a": 30, "b": 70}, 4
    counts = [sum(1 for k, _, s in _drawn(spark, quotas, shards, seed) if k == "a" and s == 0) for seed in range(120)]
    mean, variance = 25 * 0.3, 25 * 0.3 * 0.7 * 75 / 99
    assert abs(np.mean(counts) - mean) < 0.6 and 0.6 * variance < np.var(counts) < 1.5 * variance


def test_mix_follows_the_draws(spark, data):
    """Each shard takes its blocks' words, sources come near their targets, reruns agree, another seed mixes anew."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    mixed = mixing.mix(docs, shards=4, keep=("doc_id", "source")).cache()
    rows = mixing.shard_rows(mixed, 4).collect()
    longest, words, targets = Counter(), Counter(), {}
    for r in mixed.collect():
        longest[r.source] = max(longest[r.source], r["size"])
        words[r.source] += r["size"] * len(r.copies)
        targets[r.source] = r.target
        assert len({c.repeat for c in r.copies}) == len(r.copies) <= mixing.MOST_REPEATS
    assert all(abs(words[s] - targets[s]) <= longest[s] for s in targets)
    assert len(rows) == sum(len(r.copies) for r in mixed.collect())
    assert [(r.shard, r.position) for r in rows] == sorted((r.shard, r.position) for r in rows) and {r.shard for r in rows} == set(range(4))
    by_shard = Counter()
    for r in rows:
        by_shard[r.shard] += r["size"]
    assert min(by_shard.values()) > sum(by_shard.values()) / 10  # the longest documents are larger than a block
    place = lambda m: sorted((r.doc_id, [(c.repeat, c.shard, c.position) for c in r.copies]) for r in m.collect())
    assert place(mixed) == place(mixing.mix(docs.repartition(7), shards=4, keep=("doc_id", "source")))
    other = mixing.mix(docs, shards=4, seed=8, keep=("doc_id", "source"))
    assert place(mixed) != place(other)


def test_mix_awkward(spark, awkward, none):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == len(ROWS) and all(len(r.copies) <= 3 and (r["size"] or not r.copies) for r in rows)
    assert sum(r.target for r in {x.source_size: x for x in rows}.values()) > 0
    assert mixing.mix(none).count() == 0 and mixing.shard_rows(mixing.mix(none)).count() == 0
    many = spark.range(3000).select("id", F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"), F.col("id").cast("string").alias("source"))
    got = mixing.mix(many, keep=("id",)).collect()
    assert len(got) == 3000 and {r.source_size for r in got} == {3}


def test_urls_awkward(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://COM/en/x?y"), (4, "x://a.example.com/en/7#z"), (5, "http://example.com"), (6, "http://xcom/en/"), (7, ""), (None, "http://b.net/de/"), (7, "")]
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), url_filters.rules_frame(spark)).collect()}
    assert got[3, "com", "/en/x"] == ("com/en/", "block") and got[4, "a.example.com", "/en/7"] == ("example.com/en/7", "allow")
    assert got[6, "xcom", "/en/"] == (None, "allow") and got[1, "", ""] == (None, "allow") and got[None, "b.net", "/de/"] == ("net/de/", "allow")
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string"), url_filters.rules_frame(spark)).count() == 0


def test_urls_of_many_ranges(spark, data, monkeypatch):
    """One host with most pages, rules above, at and below it: each range starts with the stack before it."""
    rules = [("com", "/", "block"), ("hot.com", "/a", "allow"), ("x.hot.com", "/a/b", "block"), ("zz.com", "/", "allow"), ("com", "/a/", "allow")]
    urls = [(i, f"http://{'hot.com' if i % 3 else ('x.hot.com', 'b.com', 'y.zz.com', 'q.net')[i // 3 % 4]}/{('a', 'a/b', 'c')[i % 5 % 3]}/{i}") for i in range(4000)]
    monkeypatch.setattr(url_filters, "RANGE_BYTES", 1000)
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), url_filters.rules_frame(spark, rules)).collect()}

    def want(url):
        host, _, path = url.split("://")[1].partition("/")
        fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[2:] if fits else (None, "allow")

    assert got == {i: want(u) for i, u in urls}


def test_two_writers_and_vacuum(spark, tmp_path):
    a, b = (sharding.ShardTable(spark, str(tmp_path / "t"), "id long", fanout=2) for _ in range(2))
    real, turns = a.commit, []

    def late(base, runs):
        if not turns:
            turns.append(b.append(spark.range(10, 20)))  # another writer commits in between
        return real(base, runs)

    a.commit = late
    a.append(spark.range(10))
    assert a.read().count() == 20 and a.versions() == [1, 2]
    lost = a.write_runs(spark.range(5))  # a writer that never commits
    a.compact()
    assert len(a.manifest()[1]) == 1 and a.vacuum() == 0  # all young
    assert a.read(2).count() == 20
    assert a.vacuum(keep_versions=1, grace_seconds=-5.0) == 3 and len(lost) == 1
    assert a.read().count() == 20 and len(a.versions()) == 1


def test_tiers_that_do_not_fill_and_file_sizes(spark, tmp_path):
    t = sharding.ShardTable(spark, str(tmp_path / "t"), "id long, v string", target_bytes=400_000, fanout=3, smallest=1 << 10)
    rows = lambda a: spark.range(a, a + 20_000).select("id", F.md5(F.col("id").cast("string")).alias("v"))
    t.append(rows(0))
    t.append(rows(20_000))
    assert t.compact() == 2 and len(t.manifest()[1]) == 2
    t.append(rows(40_000))
    t.compact()
    run = t.manifest()[1][0]
    assert len(t.manifest()[1]) == 1 and t.read().count() == 60_000 and 0.4 < run.bytes / run.files / t.target_bytes < 2


def test_shards(spark, awkward, none, tmp_path):
    t = sharding.shard_documents(awkward, str(tmp_path / "a"), arrivals=4, fanout=2)
    assert t.read().exceptAll(awkward).count() == 0 and t.read().count() == len(ROWS)
    v, runs = t.manifest()
    with pytest.raises(sharding.CommitConflict):
        t.commit(v - 1, runs)
    assert sharding.shard_documents(none, str(tmp_path / "b")).read().count() == 0


def test_quality_awkward(spark, awkward, none):
    rows = quality_rules.quality(awkward).collect()
    assert len(rows) == len(ROWS) and all(r.base_failed for r in rows if r.n_words < 10)
    assert quality_rules.quality(none).count() == 0
    many = spark.createDataFrame([(i, f"Shared banner line {i}\nown text of document {chr(97 + i % 26) * (2 + i // 26)} alone", "h") for i in range(30)], "doc_id long, text string, source string")
    left = {r.text.split("\n")[0][:6] for r in quality_rules.without_frequent_lines(many, least_limit=5).collect()}
    assert left == {"own te"}


def _lined(spark):
    """Hosts with and without lines that more of their documents hold than the limit; documents that lose little, and much."""
    dice = random.Random(2)
    word = lambda: "".join(dice.choice("abcdefghijklmnop") for _ in range(7))
    rows = []
    for host, n in (("big", 300), ("small", 12), (None, 60), ("clean", 50)):
        for i in range(n):
            own = "\n".join(" ".join(word() for _ in range(8)) for _ in range(2))
            banner = f"  All rights reserved {i} by the holders of this page\n" * (1 + i % 2)
            long = "Share this page with everybody whom you know and come back soon for more of the same\n" * 4
            text = own if host == "clean" else banner + own if i % 3 else (long if i % 2 else "") + "one two three four five six seven eight nine ten eleven\n" + banner
            rows.append((len(rows), text, host))
    return spark.createDataFrame([*rows, (None, None, None), (7, "", "big")], "doc_id long, text string, source string")


def test_lines_of_hosts_by_sql(spark):
    """The query's columns where lines are frequent, documents are depleted and a host is null."""
    import duckdb

    docs = _lined(spark)
    con = duckdb.connect()
    rows = [r for r in docs.collect() if r.doc_id is not None and r.text]
    con.register("documents", __import__("pyarrow").table({c: [r[c] for r in rows] for c in ("doc_id", "text", "source")}))
    cur = con.execute(quality_rules.ORACLE)
    names = [c[0] for c in cur.description]
    want = {r[names.index("doc_id")]: r for r in cur.fetchall()}
    few = docs.where("doc_id is not null and text <> ''")
    got = {r.doc_id: r for r in quality_rules.quality(few).collect()}
    assert len(got) == len(want) == len(rows)
    for d, r in got.items():
        assert tuple(r[c] for c in names) == want[d]
    lost = {d for d, r in got.items() if r.removed_chars}
    rejected = {d for d, r in got.items() if not r.base_failed and not r.kept}
    hosts = {r.doc_id: r.source for r in rows}
    assert {hosts[d] for d in lost} == {"big", "small", None} and {hosts[d] for d in rejected} == {"big", "small", None}
    assert rejected < lost and len(quality_rules.quality(docs).collect()) == docs.count()
    # What is taken out of the texts is what was counted.
    left = {r.doc_id: r.text for r in quality_rules.without_frequent_lines(few).collect()}
    size = lambda t: sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", t)))
    text = {r.doc_id: r.text for r in rows}
    assert all(size(text[d]) - size(left[d]) == r.removed_chars for d, r in got.items())


def test_scratch_tables_go(spark):
    import os

    from tidemill.llm.shared import scratch, shared_dir, written

    folder = f"{shared_dir(spark)}/tidemill"
    kept = written(spark.range(3), "kept")
    before = set(os.listdir(folder))
    with pytest.raises(ValueError), scratch(spark):
        written(spark.range(5), "gone")
        raise ValueError
    assert set(os.listdir(folder)) == before and kept.count() == 3


def test_pipeline_awkward(spark, awkward, none, data, tmp_path):
    """Nulls, repeats, long texts, clashing columns and empty tables through all stages."""
    import corpus_pipeline

    for name, rows in (("a", awkward), ("b", none)):
        path = str(tmp_path / name)
        rows.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 0), (5, 1), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
        out = corpus_pipeline.run(spark, path)
        found = {r.doc_id for r in out.collect()}
        assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        # Of the copies the smallest id stays; texts without words are never taken.
        assert found <= ({1, 5, 6, 8, None} if name == "a" else set()) and (name == "b" or {1, 5} <= found)


def test_pipeline_drops_toxic_documents(spark, tmp_path):
    import corpus_pipeline

    rows = _labelled(spark)
    rows.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    rows.where("doc_id % 2 = 0").select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path)).collect()}
    toxic = {r.doc_id for r in rows.where("toxic = 1").collect()}
    assert len(left & toxic) <= 0.05 * len(toxic) and len(left - toxic) >= 0.98 * (600 - len(toxic))


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rest = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rest = stage(spark, rest, data).cache()
        assert rest.columns == docs.columns
    out = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    sums = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert sums <= packing.WINDOW


def _near_copies(rows):
    """Of each SimHash group of (doc_id, text) the smallest id, by the definition."""
    import xxhash

    fp = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    edges = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    root = {b: a for a, b in components.forest(edges)}
    return [(d, t) for d, t in rows if root.get(d, d) == d]


def test_pipeline_by_brute_force(spark, data):
    """run()'s pieces are those of the documents that each stage's definition leaves; only the toxicity decision is reused."""
    import corpus_pipeline
    import duckdb
    import pyarrow as pa
    from tokenizers import Tokenizer

    every = spark.read.parquet(f"{data}/documents.parquet")
    clean = corpus_pipeline.toxicity_stage(spark, every, data).select("doc_id", "text", "source").orderBy("doc_id").collect()
    source = {r.doc_id: r.source for r in clean}
    unlike = _near_copies([(r.doc_id, r.text) for r in clean])
    spans, left = {d: s for d, _, s, _ in _repeats(unlike)}, []
    for d, t in unlike:
        b = bytearray((t or "").encode())
        for start, length in reversed(spans[d]):
            del b[start : start + length]
        left.append((d, b.decode("utf-8", "ignore")))
    assert len(unlike) < len(clean) and any(spans.values())
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [d for d, _ in left], "text": [t for _, t in left], "source": [source[d] for d, _ in left]}))
    cur = con.execute(mixing.ORACLE)
    names = [c[0] for c in cur.description]
    mixed = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixed if r["taken"]}

    tokenizer, text = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), dict(left)
    ids = {d: np.array([*tokenizer.encode(text[d], add_special_tokens=False).ids, packing.END_ID], "<u4") for d in want}
    copies = {}
    for r in corpus_pipeline.run(spark, data).collect():
        copies.setdefault((r.doc_id, r.uid), []).append(r)
    assert dict(Counter(d for d, _ in copies)) == want
    for (d, _), pieces in copies.items():
        pieces.sort(key=lambda r: r.start)
        ends = list(np.cumsum([p.length for p in pieces]))
        assert [p.start for p in pieces] == [0, *ends[:-1]] and ends[-1] == len(ids[d]) == pieces[0].doc_tokens
        assert all(p.ids_crc32 == zlib.crc32(ids[d][p.start : p.start + p.length].tobytes()) for p in pieces)
