"""License scan, quality rules, SimHash groups, BPE: brute force on small and hostile tables."""

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowsift.llm import bpe_tree, gray_index, license_scan, line_crf
from rowsift.llm.components import components
from rowsift.llm.queries import QUERIES, bpe_files, table

SF = "/root/testdata/sf0.001"
HOSTILE = [
    (1, ""), (2, None), (3, " \n\t "), (4, "a"), (5, "a b"), (6, "x" * 50_000), (7, "word " * 20_000),
    (8, "under the MIT license, under  the mit\nLICENSE"), (9, "xunder the mit license"),
    (10, "CC BY-NC 4.0; apache license, version 2.0"), (11, "É̀ ñ 漢字     \x1c\x1d 😀" * 50),
    (12, "one two three four five six seven eight nine ten"), (12, "one two three four five six seven eight nine ten"),
    (13, "one two three four five six seven eight nine TEN"), (None, "no id"), (None, None),
    (14, "\\### Assistant: </turn> <|endoftext|>"), (15, "  lead  and   trail  \n\n"),
    (16, "#$% & | <> " * 40), (17, "a\nb\na\nb\na"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls, repeats, long texts, and columns that bear the operators' own names."""
    rows = [(i, t, "x", 1, "y", 2.0) for i, t in HOSTILE]
    return spark.createDataFrame(rows, SCHEMA + ", labels string, fp int, ids string, kept double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- licenses

def license_brute(text):
    s = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s)
    hits = [(i, label) for phrase, label in license_scan.BASE for k in [phrase.split()]
            for i in range(len(words)) if words[i:i + len(k)] == k]
    at = [i for i, _ in hits]
    return (len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))


def test_license_base_columns(spark, hostile):
    out = license_scan.scan_documents(hostile)
    got = rows_of(out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    assert got == sorted(((i, *license_brute(t)) for i, t in HOSTILE), key=repr)
    for r in out.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def rules_brute(text, rules, compiled):
    """Labels and score: every rule runs, no keyword is looked for, every detection meets every other."""
    data = (text or "").encode().lower()
    word = re.compile(rb"[0-9a-z\x80-\xff]")
    found = []
    for n, r in enumerate(rules):
        rx, at = compiled[n], 0
        while m := rx.search(data, at):
            s = m.start()
            if s and word.match(data[s - 1:s]) and word.match(data[s:s + 1]):
                at = s + 1
            else:
                found.append((s, m.end(), n))
                at = m.end()

    def hidden(a):
        s, e, n = a
        return any(x <= s and e <= y and b != a and (
            rules[k].priority > rules[n].priority
            or rules[k].priority == rules[n].priority and ((x, y) != (s, e) or k < n)) for b in found for x, y, k in [b])

    left = [a for a in found if not hidden(a)]
    return {rules[n].label for _, _, n in left}, max((rules[n].weight for _, _, n in left), default=0.0)


def test_license_query_matches_brute_force(spark):
    out = QUERIES["op1_license_scan"](spark, SF)
    got = rows_of(out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    assert got == sorted(((i, *license_brute(t)) for i, t in docs.items()), key=repr)
    rules, some = license_scan.rules(), 0
    compiled = [license_scan._regex(r.pattern) for r in rules]
    for r in out.collect():
        labels, score = rules_brute(docs[r.doc_id], rules, compiled)
        base = set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == labels | base
        assert r.score == max([score] + [0.9] * bool(base))
        some += bool(r.labels)
    assert some


def test_license_signatures_are_written_one_by_one():
    """Hundreds of them, each with a keyword that any text of it holds, and a form that it finds."""
    from rowsift.llm.license_signatures import SIGNATURES
    written = len(SIGNATURES) + sum(len(line.split(" | ")[1].split(" / ")) for line in license_scan.NAMES + license_scan.NOTICES) + 12
    assert written >= 300 and len({line.split(" | ")[2] for line in SIGNATURES}) == len(SIGNATURES)
    scanner = license_scan.Scanner()
    for line in SIGNATURES:
        label, priority, pattern, key = (x.strip() for x in line.split(" | "))
        sample = pattern.split("|")[0] if "(" not in pattern and "|" in pattern else pattern
        while (m := re.search(r"\(\?:([^()]*)\)\??", sample)):  # the first choice of each group
            sample = sample[:m.start()] + m[1].split("|")[0] + sample[m.end():]
        sample = re.sub(r"\.\{[0-9]+,[0-9]+\}\?", "some one", sample).replace(" ?", " ")
        sample = re.sub(r"\[(.)[^]]*\]", r"\1", sample)
        sample = re.sub(r"(.)\?", r"\1", sample)
        found = {scanner.rules[n].label for _, _, n in scanner.detections(sample.replace(" ", ", ").encode())}
        assert label in found, (line, sample)


def test_license_priorities_matter():
    """With one priority for all rules other labels come out."""
    texts = {
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.": "apache-2",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License": "lgpl-2.1",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "www.gnu.org/licenses/gpl-3.0": "gpl-3",
        "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3",
        "Copyright 2020 Unicode, Inc. All rights reserved. Distributed under the Terms of Use": "unicode",
    }
    from dataclasses import replace
    ranked = license_scan.Scanner()
    flat = license_scan.Scanner([replace(r, priority=1) for r in ranked.rules])
    for text, label in texts.items():
        assert label in ranked.scan(text.encode())[5].split(","), text
    # a weak rule that runs over the whole sentence would hide the license it speaks of
    for text, label in {"This software is made available under the terms of the MIT License": "mit",
                        "The program is distributed under the terms of the GNU Affero General Public License": "agpl-3",
                        "This library is free and distributed under the BSD License": "bsd",
                        "The code is provided under the terms of the Mozilla Public License, v. 2.0 license": "mpl-2"}.items():
        strong, weak = (set(x.scan(text.encode())[5].split(",")) - {""} for x in (ranked, flat))
        assert label in strong and "license-reference" in strong and weak == {"license-reference"}, (text, strong, weak)
    one = [license_scan.Rule("weak", "alpha beta gamma delta", ("alpha",), 1, 0.4), license_scan.Rule("strong", "beta gamma", ("gamma",), 5, 0.9)]
    assert license_scan.Scanner(one).scan(b"alpha beta gamma delta")[5] == "strong,weak"
    assert license_scan.Scanner([replace(one[0], priority=6), one[1]]).scan(b"alpha beta gamma delta")[5] == "weak"
    assert license_scan.Scanner([one[0], replace(one[1], priority=1)]).scan(b"alpha beta gamma delta")[5] == "weak"


@pytest.mark.parametrize("text, labels", [
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"),
    ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2"),
    ("distributed under the terms of the GNU Lesser General Public License v2.1", "lgpl-2.1"),
    ("This work is under a Creative Commons Attribution-NonCommercial 4.0 licence", "cc-by-nc-4.0"),
    ("https://creativecommons.org/licenses/by-sa/3.0/", "cc-by-sa-3.0"),
    ("Redistribution and use in source and binary forms, with or without modification", "bsd"),
    ("(c) 2019 All Rights Reserved", "all-rights-reserved"),
    ("a mitigated apachean text", ""),
])
def test_license_labels(text, labels):
    assert license_scan.Scanner().scan(text.encode())[5] == labels


def test_license_suppression():
    s = license_scan.Scanner()
    found = s.detections(b"under the terms of the mit license")
    assert len(found) > 1 and len(s.resolve(found)) == 1
    a, b = (next(n for n, r in enumerate(s.rules) if r.priority == p) for p in (5, 2))
    # contained and lower goes, contained and higher stays, equal intervals keep one, overlap stays
    assert s.resolve([(0, 10, a), (2, 9, b)]) == [(0, 10, a)]
    assert s.resolve([(0, 10, b), (2, 9, a)]) == [(0, 10, b), (2, 9, a)]
    assert len(s.resolve([(0, 10, a), (0, 10, b), (0, 10, a)])) == 1
    assert len(s.resolve([(0, 10, a), (5, 12, b)])) == 2
    assert len(s.rules) > 300


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.integers(0, 40)), max_size=25))
def test_license_suppression_brute(raw):
    s = license_scan.Scanner()
    found = [(a, a + n, r) for a, n, r in raw]
    kept = s.resolve(found)
    key = [(s.rules[r].priority, e - a, -a) for a, e, r in found]

    def beaten(i):
        a, e, _ = found[i]
        return any(x <= a and e <= y and (key[j][0] > key[i][0] or key[j][0] == key[i][0] and y - x > e - a)
                   for j, (x, y, _) in enumerate(found))

    # exactly the intervals that nothing stronger contains remain
    assert {(a, e, s.rules[r].priority) for a, e, r in kept} >= {
        (a, e, s.rules[r].priority) for i, (a, e, r) in enumerate(found)
        if not beaten(i) and all(not (x <= a and e <= y) or s.rules[q].priority <= s.rules[r].priority for x, y, q in found)
        and not any((x, y) == (a, e) and s.rules[q].priority > s.rules[r].priority for x, y, q in found)}
    for a, e, r in kept:
        assert not any(x <= a and e <= y and (x, y) != (a, e) and s.rules[q].priority >= s.rules[r].priority for x, y, q in kept)


# ---------------------------------------------------------------- quality rules

def quality_brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i:i + 5]), []).append(i)
    cover = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), n < 10 or 100 * len(cover) > 20 * n)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_base_columns(spark, hostile, none):
    out = line_crf.judge_lines(hostile, line_crf.prior_weights())
    cheap = [(i, t) for i, t in HOSTILE if i != 7]
    assert rows_of(out.where("doc_id is null or doc_id <> 7").select("doc_id", *NAMES)) == sorted(
        ((i, *quality_brute(t)) for i, t in cheap), key=repr)
    seven = out.where("doc_id = 7").first()
    assert (seven.n_words, seven.n_repeat_words, seven.kept) == (20_000, 20_000, False)
    assert not out.where("base_failed and kept").count()
    assert line_crf.judge_lines(none, line_crf.prior_weights()).count() == 0


def test_quality_query(spark):
    out = QUERIES["op7_quality_rules"](spark, SF)
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert rows_of(out.select("doc_id", *NAMES)) == sorted(((i, *quality_brute(t)) for i, t in docs.items()), key=repr)


def test_quality_query_kept_matches_brute_force(spark):
    """The verdict of every document by trying label paths in plain Python, not by the vectorised decoder."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    weights = line_crf.train_on_labels(docs, labels)
    emission, step = np.array(weights["emission"]), np.array(weights["transition"])
    got = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, SF).collect()}
    good = 0
    for d in docs.collect():
        observed, counts, _ = line_crf.observe((d.text or "").encode())
        scores = [[sum(emission[o][s] for o in line) for s in (0, 1)] for line in observed]
        best = [([s], scores[0][s]) for s in (0, 1)] if scores else []
        for line in scores[1:]:  # the best path to each state, written out
            best = [max(((path + [s], v + step[path[-1]][s] + line[s]) for path, v in best), key=lambda x: x[1]) for s in (0, 1)]
        path = max(best, key=lambda x: x[1])[0] if best else []
        words = sum(counts)
        share = sum(int(c) for c, s in zip(counts, path) if s) / words if words else 0.0
        r = got[d.doc_id]
        assert r.kept == (not r.base_failed and share >= line_crf.SHARE), d.doc_id
        good += r.kept
    assert 0 < good < len(got)


def test_quality_keeps_columns(spark, hostile):
    kept = line_crf.judge_lines(hostile, line_crf.prior_weights(), keep_columns=True)
    assert kept.columns == hostile.columns and kept.dtypes == hostile.dtypes
    ids = [r.doc_id for r in line_crf.judge_lines(hostile, line_crf.prior_weights()).where("kept").collect()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(ids) and 12 in ids


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        s, t = rng.standard_normal((n, 2)), rng.standard_normal((2, 2))
        paths = [[(k >> i) & 1 for i in range(n)] for k in range(2 ** n)]

        def score(p):
            return sum(s[i, p[i]] for i in range(n)) + sum(t[a, b] for a, b in zip(p, p[1:]))

        assert score(line_crf.viterbi(s, t).tolist()) == pytest.approx(max(map(score, paths)))
    assert len(line_crf.viterbi(np.empty((0, 2)), t)) == 0


def test_field_on_held_out_documents(spark):
    """Trained on some labelled documents, judged on others."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    weights = line_crf.train_on_labels(docs, labels.where("doc_id % 2 = 0"), n_docs=600)
    out = line_crf.judge_lines(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), weights).join(labels, "doc_id")
    n = {(r.quality, r.kept): r.n for r in out.where("not base_failed").groupBy("quality", "kept").agg({"*": "count"})
         .withColumnRenamed("count(1)", "n").collect()}
    assert n.get((1, True), 0) >= 0.99 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.95 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_short_documents_are_judged_by_their_lines(spark):
    """Ten to nineteen words that pass the base rules: the line labels decide, as for longer ones."""
    junk = "&&& $$$ *** %%% <<< >>> ### ||| &$* $*% *%< %<>"
    prose = "The harbour was quiet that evening and nobody spoke of rain."
    docs = spark.createDataFrame([(1, junk), (2, prose), (3, junk + " " + prose.replace(" ", " && "))], "doc_id long, text string")
    got = {r.doc_id: r for r in line_crf.judge_lines(docs, line_crf.prior_weights()).collect()}
    assert not any(r.base_failed for r in got.values()) and 10 <= got[1].n_words < 20 and 10 <= got[2].n_words < 20
    assert [got[i].kept for i in (1, 2, 3)] == [False, True, False]
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = line_crf.judge_lines(docs, line_crf.train_on_labels(docs, labels, n_docs=600)).where("not base_failed")
    assert not out.where(F.col("kept") != (F.col("content_share") >= line_crf.SHARE)).count()
    short = out.where("n_words < 20").join(labels, "doc_id").groupBy("quality").agg(F.count("*"), F.sum(F.col("kept").cast("int")))
    n = {q: (rows, kept) for q, rows, kept in short.collect()}
    assert n[0][0] >= 6 and n[0][1] == 0 and n[1][1] >= 0.95 * n[1][0]


def test_training_without_labels(spark, hostile):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert line_crf.train_on_labels(hostile, labels) == line_crf.prior_weights()
    odd = spark.createDataFrame([(None, 1), (12, None), (12, 7), (99, 0)], "doc_id long, quality int")
    assert line_crf.train_on_labels(hostile, odd) == line_crf.prior_weights()


# ---------------------------------------------------------------- SimHash

def simhash_brute(text, k=3):
    s = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", s)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups_brute(rows):
    fps = [simhash_brute(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def as_hex(df):
    from pyspark.sql import functions as F

    return rows_of(df.select("doc_id", gray_index.hex16(F.col("fp")), "component_id"))


def test_simhash_hostile(spark, hostile, none):
    assert as_hex(gray_index.near_duplicates(hostile)) == groups_brute(HOSTILE)
    assert gray_index.near_duplicates(none).collect() == []


def test_simhash_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert rows_of(QUERIES["op9_simhash_groups"](spark, SF)) == groups_brute(rows)


def test_gray_index_finds_every_link(spark, monkeypatch):
    """Dense fingerprints, small nodes: links inside, across and far from node borders."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2 ** 63, 30).astype(np.uint64)
    fps = [int(c) for c in centres]
    for c in centres[:20]:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted(set(fps) | {0, 2 ** 64 - 1, 2 ** 64 - 2})
    monkeypatch.setattr(gray_index, "NODE", 64)
    signed = [(x - 2 ** 64 if x >> 63 else x,) for x in fps]
    distinct = spark.createDataFrame(signed, "fp long")
    from rowsift.llm.common import staged

    nodes = staged(gray_index._nodes(distinct), "nodes")
    assert sorted(np.unique([f for r in nodes.where("band = 0").collect() for f in r.fps]).tolist()) == sorted(x for x, in signed)
    got = {r.node: r.component for r in components(gray_index._edges(nodes, 3)).collect()}
    label = {x: x for x, in signed}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = root(signed[i][0]), root(signed[j][0])
                label[max(x, y)] = min(x, y)
    want = {x: root(x) for x, in signed}
    assert {x: got.get(x, x) for x, in signed} == want and len(set(want.values())) < len(want)


def test_links_between_is_exhaustive():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 63, 1, dtype=np.uint64)
    a = np.sort(np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, (200, 3)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)))
    for d in (0, 1, 2, 3):
        u, v = gray_index.links_between(a, a, d, True)
        want = {(int(x), int(y)) for i, x in enumerate(a) for y in a[:i] if 0 < int(x ^ y).bit_count() <= d}
        assert {(max(int(x), int(y)), min(int(x), int(y))) for x, y in zip(u, v)} == {(max(p), min(p)) for p in want}


def test_components_of_paths_stars_and_nothing(spark):
    rng = np.random.default_rng(3)
    edges = [(int(i), int(i + 1)) for i in range(100, 160)] + [(1000, int(k)) for k in range(1001, 1100)]
    edges += [(5, 5), (7, 6), (6, 7)] + [tuple(map(int, rng.integers(2000, 2200, 2))) for _ in range(150)]
    label = {}

    def root(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        label[max(a, b)] = min(a, b)
    want = {x: root(x) for x in label}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


# ---------------------------------------------------------------- BPE

@pytest.fixture(scope="module")
def bpe():
    return bpe_tree.BpeTree(bpe_tree.read_ranks(bpe_files()["rank_path"]), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tik(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def bpe_brute(tik, text):
    ids = tik.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_bpe_hostile(spark, hostile, none, tik):
    got = rows_of(bpe_tree.token_digests(hostile, **bpe_files()))
    assert got == sorted(((i, *bpe_brute(tik, t)) for i, t in HOSTILE), key=repr)
    assert bpe_tree.token_digests(none, **bpe_files()).collect() == []


def test_bpe_query_matches_tiktoken(spark, tik):
    docs = table(spark, SF, "documents").collect()
    assert rows_of(QUERIES["op10_byte_bpe"](spark, SF)) == sorted(((r.doc_id, *bpe_brute(tik, r.text)) for r in docs), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text(alphabet=" \n\t\x1c\x85  ab1é漢'.!​﻿", max_size=200)))
def test_bpe_any_text(bpe, tik, text):
    want = tik.encode_ordinary(text)
    assert bpe.encode(text).tolist() == want and bpe.decode(want) == text.encode()


def test_bpe_long_pieces_and_blocks(bpe, tik, monkeypatch):
    monkeypatch.setattr(bpe_tree, "BLOCK_CHARS", 1000)
    monkeypatch.setattr(bpe_tree, "REMEMBERED", 50)
    for text in ("ab" * 9000, "é" * 4000, "a b  c\n\n d " * 3000, "x" * 33, " " * 5000 + "y", "word, " * 4000):
        assert bpe.encode(text).tolist() == tik.encode_ordinary(text)


def test_bpe_single_and_table_merges_agree(bpe):
    rng = np.random.default_rng(0)
    pieces = [bytes(rng.integers(97, 103, int(n)).astype(np.uint8)) for n in rng.integers(1, 33, 400)]
    table_ids = bpe.merge_many(list(set(pieces)))
    for p in pieces:
        assert np.frombuffer(table_ids[p], "<i4").tolist() == bpe.merge(p)


def test_bpe_documents_round_trip(spark, hostile):
    enc = bpe_tree.encode_documents(hostile, **bpe_files())
    assert enc.columns == ["doc_id", "text", "labels", "fp", "kept", "ids", "n_tokens"]
    back = bpe_tree.decode_documents(enc.select("ids", enc.text.alias("key")), key="key", **bpe_files())
    for r in back.collect():
        assert bytes(r.decoded).decode() == (r.key or "")


def test_bpe_other_vocabulary(bpe):
    """A tiny rank file: bytes and three merges; ties go left."""
    toks = [bytes([b]) for b in range(256)] + [b"aa", b"ab", b"aab"]
    ranks = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(toks))
    t = bpe_tree.BpeTree(ranks, r"\S+|\s+")
    own = tiktoken.Encoding("tiny", pat_str=r"\S+|\s+", mergeable_ranks=t.ranks, special_tokens={})
    for text in ("aaab", "aaa", "aabaab", "ba", "aaaaaaab" * 20):
        assert t.encode(text).tolist() == own.encode_ordinary(text)
