import hashlib
import math
import re
from collections import Counter
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.llm import collocations, queries, toxicity, vector_codes

INSULTS = ["blockhead", "dimwit", "nincompoop", "scoundrel"]
PLAIN = "river stone window garden paper silver cloud yellow market letter winter bridge candle forest sudden little".split()


def labelled(n=400, seed=5):
    """Texts and labels: toxic ones hold two or three insults, in forms that differ."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = list(rng.choice(PLAIN, int(rng.integers(5, 60))))
        if i % 4 == 0:
            for _ in range(int(rng.integers(2, 4))):
                words.insert(int(rng.integers(len(words) + 1)), str(rng.choice(INSULTS)) + str(rng.choice(["", "s", "ish", "ery"])))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_marginals_equal_sums_over_all_paths():
    rng = np.random.default_rng(1)
    move, first = rng.normal(0, 1, (3, 3)), np.array([1, 0, 0, 1, 1, 0, 0, 0, 0], bool)
    emit = rng.normal(0, 1, (9, 3))
    got = toxicity.marginals(emit, first, move)
    starts = [*np.flatnonzero(first), 9]
    for a, b in zip(starts, starts[1:]):
        want = np.zeros((b - a, 3))
        for path in product(range(3), repeat=b - a):
            p = math.exp(sum(emit[a + i, y] + move[path[i - 1] if i else toxicity.OUT, y] for i, y in enumerate(path)))
            for i, y in enumerate(path):
                want[i, y] += p
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))
    long = rng.normal(0, 1, (5000, 3))
    whole = toxicity.marginals(long, np.arange(5000) == 0, move)
    apart = toxicity.marginals(np.vstack([long, long]), np.arange(10000) % 5000 == 0, move)
    assert np.allclose(apart, np.vstack([whole, whole])) and toxicity.marginals(np.zeros((0, 3)), np.zeros(0, bool), move).shape == (0, 3)


def test_toxic_spans_and_scores_on_rows_not_learned_from(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    fresh = labelled(80, seed=9)
    got = {r["doc_id"]: r for r in toxicity.judged(spark.createDataFrame(fresh, "doc_id long, text string, y int"), model, keep=["doc_id"]).collect()}
    for i, text, y in fresh:
        found = [text[int(a) : int(b)] for a, _, b in (s.partition(":") for s in got[i]["spans"].split(",") if s)]
        assert (got[i]["score"] >= 0.3) == bool(y)
        assert Counter(" ".join(found).split()) == Counter(w for w in text.split() if w.startswith(tuple(INSULTS)))


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    rows = labelled(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.judged(odd_docs, model, keep=odd_docs.columns[:1]).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] < 0.3 and r["spans"] == "" for r in got)
    assert toxicity.judged(no_docs, model, keep=["doc_id"]).count() == 0
    nothing = toxicity.fit(no_docs, labels.limit(0))
    assert {r["score"] for r in toxicity.judged(odd_docs, nothing, keep=["doc_id"]).collect()} == {0.0}
    one_class = toxicity.fit(docs, labels.where("toxic = 1"))
    assert {r["score"] for r in toxicity.judged(odd_docs, one_class, keep=["doc_id"]).collect()} == {1.0}


def test_word_table_starts_afresh(monkeypatch):
    monkeypatch.setattr(toxicity, "_CACHE", 5)
    rng = np.random.default_rng(2)
    model = toxicity.ToxicModel(*[rng.normal(size=(toxicity.FEATURES, 3)).astype(np.float32) for _ in range(3)], np.zeros((3, 3)))
    table = toxicity.WordTable(model)
    for words in (PLAIN[:4], PLAIN[3:9], PLAIN[:4]):
        rows = table.rows(words)
        assert np.allclose(table.scores[rows], [fresh_row(model, w) for w in words])


def fresh_row(model, word):
    f = toxicity.features(word)
    return np.concatenate([model.own[f].sum(axis=0), model.left[f[-1]], model.right[f[-1]]])


def test_toxicity_query_on_rows_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op11_toxicity(spark, sf).toPandas()
    held = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id").query("held_out")
    assert len(got) == len(pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id"]))
    assert held.predicted.eq(held.toxic).mean() > 0.9 and got.score.between(0, 1).all()
    assert held.predicted[held.toxic == 0].mean() < 0.03


def plain_phrases(rows, most=3, least=10, top=2000):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts.update((lang, *words[i : i + m]) for m in range(1, most + 1) for i in range(len(words) - m + 1))
    out = {}
    for key, a in counts.items():
        lang, words = key[0], key[1:]
        if len(words) < 2 or a < least:
            continue
        cuts = [(1_000_000 * a * a // (counts[(lang, *words[:k])] * counts[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[lang, words] = (score, a, counts[(lang, *words[:k])], counts[(lang, *words[k:])])
    kept = {}
    for (lang, words), v in out.items():
        longer = [x[1] for (g, w), x in out.items() if g == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if not any(100 * b >= 50 * v[1] for b in longer):
            kept.setdefault(lang, []).append((-v[0], -v[1], " ".join(words).encode(), v))
    return sorted((lang, r, p.decode(), v[1], v[2], v[3], n[lang], v[0]) for lang, x in kept.items() for r, (_, _, p, v) in enumerate(sorted(x)[:top], 1))


def as_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("bits", [None, 3, 16])
def test_phrases_equal_plain_counts_whatever_the_sketch(spark, documents, bits):
    rng = np.random.default_rng(4)
    odd = ["New\tYork  city, new york City!", "a b a b a b a b a b a b", "é É Ünder é É ünder", "x" * 3000 + " y", None, "", "one.two,three;four", " \t "]
    rows = [(str(rng.choice(["en", "fr"])) if i % 5 else None, odd[i % len(odd)]) for i in range(160)] + [("und", "new york city")] * 12
    rows += list(documents[["lang", "text"]].head(40).itertuples(index=False, name=None))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = as_rows(collocations.collocations(df, bits=bits))
    assert got == plain_phrases(rows) and any(r[0] == "und" for r in got)


def test_phrases_of_long_texts_cut_at_pieces(spark, monkeypatch):
    texts = ["alpha beta gamma. " * 50 + "alpha beta, gamma delta " * 30]
    whole = [[(m, words.phrase(i, m)) for words in collocations.stretches(texts, ["en"]) for m, at, _ in words.sequences(3) for i in at.tolist()]]
    monkeypatch.setattr(collocations, "_CUT", 64)
    cut = list(collocations.stretches(texts, ["en"]))
    again = [[(m, words.phrase(i, m)) for words in cut for m, at, _ in words.sequences(3) for i in at.tolist()]]
    assert len(cut) > 5 and Counter(whole[0]) == Counter(again[0])


def test_phrases_of_odd_rows(spark, odd_docs, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    got = as_rows(collocations.collocations(odd_docs))
    assert got == plain_phrases([(r["lang"], r["text"]) for r in odd_docs.collect()])


def test_counters_stop_and_merge(spark):
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 2**63, 4000).astype(np.uint64)[rng.integers(0, 300, 4000)]
    parts = []
    for h in np.array_split(hashes, 3):
        s = collocations.Sketch(16, 10)
        s.add(h)
        parts.append(s.slices())
    bits = np.zeros((collocations.ROWS, 1 << 13), np.uint8)
    for r in collocations.merged(spark.createDataFrame(pd.concat(parts), "row int, slice int, counters binary"), 10).collect():
        bits[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    for row in range(collocations.ROWS):
        want = np.bincount(collocations.places(hashes, row, 16), minlength=1 << 16) >= 10
        assert (np.unpackbits(bits[row]).astype(bool) == want).all()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][2]) // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(r[2])[p] for r in first] for p in range(parts)]
    nearest = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = {}
        for _, _, v in kept:
            for p, x in enumerate(cut(v)):
                groups.setdefault((p, nearest(p, x)[1]), []).append(x)
        for (p, e), xs in groups.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out, per = [], Counter()
    for i, lab, v in kept:
        near = [nearest(p, x) for p, x in enumerate(cut(v))]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near)))
        per[lab] += out[-1][3]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, per[lab]) for i, lab, c, e in out), key=str), digest


def test_codes_equal_a_plain_lloyd(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(0, 0.3, (150, 32)).astype(np.float32)
    rows = [(int(i // 2) if i % 7 else None, [float(x) for x in v], int(i % 3) if i % 4 else None) for i, v in enumerate(base)]
    rows += [(900, None, 1), (901, [None] + [0.5] * 31, 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] * 32, 2), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("own")).repartition(4)
    codes, books = vector_codes.compress(df)
    got = sorted(((r["id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.with_label_errors(codes).collect()), key=str)
    want, digest = plain_codes([(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    assert got == want and books.digest() == digest


def test_codes_of_few_and_of_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    codes, books = vector_codes.compress(spark.createDataFrame([], kind))
    assert books is None and vector_codes.with_label_errors(codes).count() == 0
    few = [(1, [0.5] * 16, None), (2, [-0.5] * 16, None)]
    codes, books = vector_codes.compress(spark.createDataFrame(few, kind))
    assert books.entries.shape == (16, 2, 1) and sorted(r["code"] for r in codes.collect()) == ["00" * 16, "01" * 16]
    for bad in ([(1, [0.5] * 15, 1)], [(1, [1e30] * 16, 1)], [(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)]):
        with pytest.raises(Exception, match="equal parts|too large|different lengths"):
            vector_codes.compress(spark.createDataFrame(bad, kind))[0].count()


def test_only_changed_parts_are_sent(spark):
    books = vector_codes.Codebooks(np.arange(16 * 2).reshape(16, 2, 1) * 10)
    one = lambda *n: bytes(n)
    rows = [([5] * 16, one(*[0] * 16), one(*[0] * 15, 1)), ([7] * 16, one(*[1] * 16), one(*[1] * 16)), ([9] * 16, None, one(*[0] * 16))]
    df = spark.createDataFrame(rows, "whole array<bigint>, before binary, now binary")
    got = {(r["part"], r["entry"], r["place"]): r["value"] for r in vector_codes.contributions(df, books).where("value <> 0").collect()}
    want = {(p, 0, i): v for p in range(15) for i, v in ((-1, 1), (0, 9))} | {(15, 0, 0): 4, (15, 1, -1): 1, (15, 1, 0): 5}
    assert got == want
