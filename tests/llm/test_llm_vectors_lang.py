"""Language ID, centroid clustering, vector codes: brute force on small, hostile and given tables."""

import hashlib
import math
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowsift.llm import hilbert_codes, int_vectors, subword_lang, vantage_tree
from rowsift.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- language

def grams_brute(text):
    """n-grams of the words of a text with their marks, as strings."""
    words, word = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            words.append(word)
            word = ""
    marked = [f" {w} " for w in words]
    return [w[i:i + n] for w in marked for n in subword_lang.ORDERS for i in range(len(w) - n + 1) if w[i:i + n].strip()]


def bucket_brute(gram, bits):
    h, full = 0, (1 << 64) - 1
    for c in gram:
        h = (h * 0x100000001B3 + (0 if c == " " else ord(c))) & full
    m = (h + len(gram)) * 0x9E3779B97F4A7C15 & full
    return ((m ^ m >> 29) * 0x9E3779B97F4A7C15 & full) >> (64 - bits)


TEXTS = ["", "a", "The the  THE", "x1y", "…été à l'œuvre!", "ÀÉ" * 3, "İstanbul ΣΑΣ", "été", "́́", "1 2 3",
         "日本語 テキスト", "a b c d e f g", "\n\tword\r\n", "naïve coöperate " * 20, "\U0001D400\U00010400"]


@pytest.mark.parametrize("piece", [4, 7, 1 << 19])
def test_buckets_match_brute_force(monkeypatch, piece):
    """Also when a text is cut into pieces."""
    monkeypatch.setattr(subword_lang, "PIECE", piece)
    bits = 12
    weights = np.random.default_rng(1).standard_normal((1 << bits, 3))
    texts = TEXTS + [None, " ".join(TEXTS)]
    sums, counts, letters = subword_lang.text_sums(texts, weights, bits)
    for i, t in enumerate(texts):
        ids = [bucket_brute(g, bits) for g in grams_brute(t or "")]
        assert letters[i] == any(c.isalpha() for c in t or "")
        if letters[i]:
            assert counts[i] == len(ids)
            assert np.allclose(sums[i], weights[ids].sum(0))
        if t is not None:
            found, n = subword_lang.text_counts(t, bits)
            assert dict(zip(found.tolist(), n.tolist())) == {b: ids.count(b) for b in ids}


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_counts_of_any_text(text):
    found, n = subword_lang.text_counts(text, 16)
    assert n.sum() == len(grams_brute(text)) and len(found) == len({bucket_brute(g, 16) for g in grams_brute(text)})


def test_language_query_on_held_out_documents(spark):
    """Held-out accuracy over all documents, and the flags of every row."""
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in QUERIES["op11_subword_language"](spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert sorted(out) == sorted(r.doc_id for r in docs)
    right = rejected_right = n = kept = 0
    for d in docs:
        r = out[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d.text or ""))
        if r.held_out and d.lang is not None:
            n, right = n + 1, right + (r.lang_pred == d.lang)
            if not r.rejected:
                kept, rejected_right = kept + 1, rejected_right + (r.lang_pred == d.lang)
    assert n > 2000 and right >= 0.99 * n and kept >= 0.95 * n and rejected_right >= 0.99 * kept


def test_language_hostile(spark):
    en, fr = "the man and the dog went home", "le chien est dans la maison verte"
    rows = [(i, f"{t} {i}", lang) for i in range(40) for t, lang in ((en, "en"), (fr, "fr"))]
    rows += [(100, en, "en")] * 300  # copies
    rows += [(200, None, "en"), (201, "", "fr"), (202, "123 !?", "en"), (None, en, None), (None, en, "en"), (203, "привет мир", None),
             (204, fr * 50_000, None), (205, "x" * 1_200_000, None), (206, " " * 1_000_000, None)]
    docs = spark.createDataFrame([(*r, "c", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    held = subword_lang.held_out()
    model = subword_lang.train_on_languages(docs, usable=~held, n_docs=60)
    assert model.languages == ["en", "fr"]
    out = subword_lang.identify(docs, model, carry={"held_out": held})
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (200, 201, 202, 206))
    assert by[100].lang_pred == "en" and by[204].lang_pred == "fr" and by[None].lang_pred == "en" and by[203].rejected
    assert by[None].held_out is False
    same = {(r.lang_pred, r.score) for r in got if r.doc_id == 100}
    assert len(same) == 1
    none = subword_lang.train_on_languages(docs.limit(0))
    assert none.languages == [] and subword_lang.identify(docs.limit(0), none).collect() == []
    assert {r.lang_pred for r in subword_lang.identify(docs, none).collect()} == {"und"}


def test_language_predictions_do_not_see_other_columns(spark):
    docs = table(spark, SF, "documents")
    model = subword_lang.train_on_languages(docs, n_docs=100)
    a = {r.doc_id: (r.lang_pred, r.score) for r in subword_lang.identify(docs, model).collect()}
    blind = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    b = {r.doc_id - 1000: (r.lang_pred, r.score) for r in subword_lang.identify(blind, model).collect()}
    assert a == b


def test_rejection_threshold_bounds_the_error():
    """At most max_error of the calibration examples above the threshold are wrong."""
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 3, 3000)
    logits = rng.standard_normal((3000, 3)) + 2.0 * np.eye(3)[truth]
    model = subword_lang.LanguageModel(["a", "b", "c"], np.zeros((4, 2)), np.zeros((2, 3)))
    sizes = np.full(3000, 50.0)
    subword_lang._calibrate(model, logits, truth, sizes, 0.02)
    p = model.scored(logits * 50.0, sizes)
    taken = p.max(1) >= model.threshold
    assert 0.05 < taken.mean() < 1 and (p.argmax(1) != truth)[taken].mean() <= 0.02
    ece = abs(p.max(1).mean() - (p.argmax(1) == truth).mean())
    assert ece < 0.02  # the scores are probabilities


# ---------------------------------------------------------------- clusters

def usable(e):
    return e is not None and all(x is not None and math.isfinite(x) for x in e)


def clusters_brute(rows, dims=64, scale=256, k=40, rounds=5):
    kept = [(i, [math.floor(scale * float(x)) for x in e]) for i, e, *_ in rows if usable(e) and len(e) == dims]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = {}
    for _, d, j in found:
        per[j] = per.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, per[j], sum(per.values()), sha[j]) for i, d, j in found), key=repr)


def test_clusters_query_matches_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    assert rows_of(QUERIES["op12_vantage_clusters"](spark, SF)) == clusters_brute(rows)


def hostile_vectors(dims):
    rng = np.random.default_rng(dims)
    base = [[float(x) for x in rng.integers(-3, 4, dims) / 4] for _ in range(25)]
    rows = [(i % 70, base[i % 25]) for i in range(160)]  # ties, repeated ids, repeated rows
    rows += [(1000, None), (1001, []), (1002, base[0][:-1]), (1003, base[0] + [0.0]), (1004, [None, *base[0][1:]]),
             (1005, [math.nan, *base[0][1:]]), (1006, [math.inf, *base[0][1:]]), (1007, [-math.inf, *base[0][1:]]), (None, base[1]),
             (None, base[2]), (-5, [0.0] * dims), (-6, [-0.0] * dims), (1008, [-1e-9] * dims), (1009, [1000.5] * dims), (1010, [-1000.5] * dims)]
    return [(*r, i % 3 if i % 4 else None) for i, r in enumerate(rows)]


def frame(spark, rows, more=()):
    return spark.createDataFrame([(*r, 1, "x") for r in rows],
                                 "vec_id long, embedding array<double>, label int, cluster int, code string")


@pytest.mark.parametrize("k, parts", [(1, 1), (7, 3), (40, 2), (500, 3)])
def test_clusters_hostile(spark, k, parts):
    rows = hostile_vectors(8)
    df = frame(spark, rows).repartition(parts)
    assert rows_of(vantage_tree.cluster(df, dims=8, k=k)) == clusters_brute(rows, dims=8, k=k)
    assert vantage_tree.cluster(df.limit(0), dims=8, k=k).collect() == []


@pytest.mark.parametrize("dims, spread, k", [(1, 3, 9), (2, 4, 30), (3, 50, 64), (64, 300, 40), (8, 2 ** 26, 33)])
def test_tree_finds_the_nearest_with_ties(dims, spread, k):
    rng = np.random.default_rng(dims)
    cents = rng.integers(-spread, spread + 1, (k, dims))
    cents[k // 2] = cents[0]  # equal centroids
    points = np.vstack((rng.integers(-spread, spread + 1, (400, dims)), cents, (cents[:-1] + cents[1:]) // 2))
    d = ((points[:, None] - cents) ** 2).sum(2)
    who, best = vantage_tree.nearest(points, cents, vantage_tree.build_tree(cents))
    assert (best == d.min(1)).all() and (who == d.argmin(1)).all()


def test_tree_prunes_where_centroids_are_apart():
    rng = np.random.default_rng(0)
    cents = rng.integers(-10 ** 6, 10 ** 6, (512, 3))
    points = cents[rng.integers(0, 512, 2000)] + rng.integers(-50, 51, (2000, 3))
    work = []
    who, _ = vantage_tree.nearest(points, cents, vantage_tree.build_tree(cents), work)
    assert (who == ((points[:, None] - cents) ** 2).sum(2).argmin(1)).all()
    assert sum(work) < 0.2 * 2000 * 512


def test_wide_components_are_refused(spark):
    df = frame(spark, [(1, [1e30] * 8, 1)])
    with pytest.raises(Exception, match="beyond"):
        vantage_tree.cluster(df, dims=8).collect()
    big = np.array([[2 ** 27, -2 ** 27]])
    assert int_vectors.squared_distances(big, -big)[0, 0] == 2 * 2 ** 56


# ---------------------------------------------------------------- codes

def codes_brute(rows, parts=8, entries=16, rounds=6, scale=4096, dims=64):
    kept = [(i, [math.floor(scale * float(x)) for x in e], y) for i, e, y in rows if usable(e) and len(e) == dims]
    p = dims // parts
    cut = [[v[k * p:(k + 1) * p] for k in range(parts)] for _, v, _ in kept]
    first = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = [[v[k * p:(k + 1) * p] for v in first] for k in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(nearest(v[k], books[k])[1], []).append(v[k])
            books[k] = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else e for j, e in enumerate(books[k])]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = []
    for (i, _, y), v in zip(kept, cut):
        hits = [nearest(v[k], books[k]) for k in range(parts)]
        found.append((i, "".join(f"{j:02x}" for _, j in hits), sum(d for d, _ in hits), y))
    per = {}
    for _, _, d, y in found:
        per[y] = per.get(y, 0) + d
    return sorted(((i, c, d, per[y], sha) for i, c, d, y in found), key=repr)


def test_codes_query_matches_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF, "embeddings").collect()]
    assert rows_of(QUERIES["op13_hilbert_codes"](spark, SF)) == codes_brute(rows)


@pytest.mark.parametrize("parts, entries, block", [(1, 3, 4), (2, 16, 16), (4, 5, 256), (8, 200, 2)])
def test_codes_hostile(spark, monkeypatch, parts, entries, block):
    rows = hostile_vectors(8)
    df = frame(spark, rows).repartition(3)
    want = codes_brute(rows, parts, entries, rounds=3, dims=8)
    assert rows_of(hilbert_codes.compress(df, parts=parts, entries=entries, rounds=3, block=block)) == want
    if block == 16:
        monkeypatch.setattr(hilbert_codes, "BROADCAST_LABELS", 1)
        assert rows_of(hilbert_codes.compress(df, parts=parts, entries=entries, rounds=3, block=block)) == want
        assert hilbert_codes.compress(df.limit(0)).collect() == []
        assert hilbert_codes.compress(df.where("embedding is null")).collect() == []


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 4), (3, 3), (8, 2), (31, 2)])
def test_hilbert_curve(dims, bits):
    """Every cell once, and neighbours on the curve differ by one step in one component."""
    if dims * bits <= 16:
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys = hilbert_codes.hilbert_keys(cells, bits)
        assert sorted(hilbert_keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    else:
        cells = np.random.default_rng(0).integers(0, 1 << bits, (500, dims))
        keys = hilbert_codes.hilbert_keys(cells, bits)
        assert (keys >= 0).all() and len(set(keys.tolist())) == len({tuple(c) for c in cells.tolist()})


def test_shortlist_never_drops_a_nearest_entry():
    rng = np.random.default_rng(5)
    short = 0
    for _ in range(300):
        centre, p = rng.integers(-50, 51, 4), rng.integers(1, 30)
        points = centre + rng.integers(-p, p + 1, (rng.integers(1, 40), 4))
        books = rng.integers(-60, 61, (16, 4))
        who, d = hilbert_codes.settle(points, points.min(0), points.max(0), books)
        full = ((points[:, None] - books) ** 2).sum(2)
        assert (d == full.min(1)).all() and (who == full.argmin(1)).all()
        short += len(hilbert_codes.shortlist(points.min(0), points.max(0), books))
    assert short < 0.9 * 300 * 16
