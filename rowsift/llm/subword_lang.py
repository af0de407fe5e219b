"""Language identification by averaged hashed subword embeddings.

A text is lower-cased and cut into words (runs of letters and combining
marks). Every word, with a boundary mark on both sides, yields its n-grams of
``ORDERS`` code points; a rolling hash puts each into one of 2 ** ``bits``
buckets. A text is the mean of the embeddings of all its n-grams, and a linear
softmax over that mean gives the languages. Embeddings and weights are fitted
in numpy by stochastic gradient descent, one example after the other.

The confidence is calibrated on sampled documents that the descent does not
see: a temperature that depends on the number of n-grams, then the smallest
score above which at most ``max_error`` of those documents are wrong. Below it
an answer is marked ``rejected``; a text without any known n-gram gets equal
scores for all languages and is rejected too.

Mean and softmax weights are linear, so a text is scored by the sums of one
small table, ``2 ** bits`` by the fewer of languages and dimensions. A text is
read whole, in pieces of bounded size that overlap by what an n-gram spans.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_frames, staged

ORDERS = (1, 2, 3, 4)
BITS = 15
DIMENSIONS = 16
#: Bounds of the training sample: documents, and characters of each (a window of longer ones).
TRAIN_DOCS = 2400
TRAIN_CHARS = 8192
#: Parts in which the texts of a language are looked through for the sample.
SLOTS = 64
#: Characters of the short window taken from each sampled document as a second example.
SHORT_CHARS = 48
EPOCHS = 4
MAX_ERROR = 0.01
UNKNOWN = "und"
#: Characters worked on at a time.
PIECE = 1 << 19
_SPAN = max(ORDERS) - 1
_STEP = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Per code point: 1 letter, 2 combining mark, 0 anything else."""
    major = {"L": 1, "M": 2}
    return np.fromiter((major.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def word_codes(text: str, after_word: bool = False) -> tuple[np.ndarray, bool, bool]:
    """Code points of words, each run of others as one 0 (none at the start unless ``after_word``);
    whether the last character is in a word, and whether there is a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.empty(0, np.uint64), after_word, False
    kinds = _kinds()[points]
    word = kinds > 0
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[0] |= after_word
    return np.where(word, points, 0)[keep].astype(np.uint64), bool(word[-1]), bool((kinds == 1).any())


def ngram_buckets(codes: np.ndarray, bits: int):
    """For each order: the bucket of the n-gram at every place, and which places have one.

    An n-gram has no boundary inside and is not made of boundaries alone."""
    live = codes > 0
    h, inside = codes, None
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            h = h[:-1] * _STEP + codes[n - 1:]
        if n == 3:
            inside = live[1:-1]
        elif n > 3:
            inside = inside[:-1] & live[n - 2:-1]
        has = live if n == 1 else (live[:-1] | live[1:]) if n == 2 else inside
        if n in ORDERS:
            mixed = (h + np.uint64(n)) * _MIX
            yield ((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(64 - bits)).astype(np.int64), has


def _pieces(text: str):
    """A long text as arrays of codes with the number of places at which n-grams begin there."""
    carry, after = np.zeros(1, np.uint64), False
    for i in range(0, len(text), PIECE):
        codes, after, letter = word_codes(text[i:i + PIECE], after)
        codes = np.concatenate((carry, codes))
        limit = max(0, len(codes) - _SPAN)
        yield codes, limit, letter
        carry = codes[limit:]
    yield np.concatenate((carry, np.zeros(_SPAN + 1, np.uint64))), len(carry), False


def text_sums(texts, table: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the sum of the table's rows over its n-grams, their number, and whether it has a letter."""
    sums = np.zeros((len(texts), table.shape[1]))
    counts, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    padded = np.vstack((table, np.zeros((1, table.shape[1])))).T.copy()  # the last bucket stands for no n-gram

    def add(codes, starts, rows, limit):
        for bucket, has in ngram_buckets(codes, bits):
            bucket, has = bucket[:limit], has[:limit]
            at = np.where(has, bucket, len(table))
            counts[rows] += np.add.reduceat(has.astype(np.int64), starts)
            for k, column in enumerate(padded):
                sums[rows, k] += np.add.reduceat(column[at], starts)

    batch, starts, rows, size = [], [], [], 0

    def flush():
        nonlocal batch, starts, rows, size
        if rows:
            add(np.concatenate([*batch, np.zeros(_SPAN + 1, np.uint64)]), np.array(starts), np.array(rows), size)
        batch, starts, rows, size = [], [], [], 0

    for i, text in enumerate(texts):
        if not isinstance(text, str):
            continue
        text = text.lower()
        if len(text) > PIECE:
            for codes, limit, letter in _pieces(text):
                letters[i] |= letter
                if limit:
                    add(codes, np.zeros(1, np.int64), np.array([i]), limit)
            continue
        codes, in_word, letters[i] = word_codes(text)
        if not letters[i]:
            continue
        starts.append(size)
        rows.append(i)
        batch += [np.zeros(1, np.uint64), codes, np.zeros(1 if in_word else 0, np.uint64)]
        size += 1 + len(codes) + in_word
        if size >= PIECE:
            flush()
    flush()
    return sums, counts, letters


def text_counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, and how often each occurs."""
    found = []
    for codes, limit, _ in _pieces(text.lower()):
        found += [bucket[:limit][has[:limit]] for bucket, has in ngram_buckets(codes, bits)]
    return np.unique(np.concatenate(found), return_counts=True)


class LanguageModel:
    """Embeddings, softmax weights, temperature and threshold; ``languages`` in order of the weights."""

    def __init__(self, languages, embeddings, weights, temperature=(0.0, 0.0), threshold=0.0, bits=BITS):
        self.languages, self.embeddings, self.weights = list(languages), embeddings, weights
        self.temperature, self.threshold, self.bits = temperature, threshold, bits

    def scored(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities from summed logits."""
        n = np.maximum(counts, 1)
        a, b = self.temperature
        logits = sums / n[:, None] / np.exp(a + b * np.log(n))[:, None]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, texts) -> tuple[list, np.ndarray, np.ndarray]:
        """Language, score and rejection of each text (null or no letter: ``und``, 0, rejected)."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        direct = len(self.languages) <= self.weights.shape[0]
        sums, counts, letters = text_sums(texts, self.embeddings @ self.weights if direct else self.embeddings, self.bits)
        p = self.scored(sums if direct else sums @ self.weights, counts)
        score = np.where(letters, p.max(axis=1), 0.0)
        names = [self.languages[k] if has else UNKNOWN for k, has in zip(p.argmax(axis=1), letters)]
        return names, score, ~letters | (score < self.threshold)


def fit(examples: list[tuple], *, bits: int = BITS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS,
        max_error: float = MAX_ERROR, seed: int = 0) -> LanguageModel:
    """Fit on ``(language, group, buckets, counts)``; every fifth group is left to calibration.

    Each step moves the mean of an example by the same rate whatever its
    length (its n-gram weights are divided by their sum of squares)."""
    languages = sorted({e[0] for e in examples})
    rng = np.random.default_rng(seed)
    table = np.zeros((1 << bits, dimensions))
    weights = rng.standard_normal((dimensions, len(languages))) / np.sqrt(dimensions)
    known = {name: k for k, name in enumerate(languages)}
    rows = [(known[y], g, ids, n / n.sum()) for y, g, ids, n in examples if len(ids)]
    held = [r for r in rows if r[1] % 5 == 4]
    own = [r for r in rows if r[1] % 5 != 4] or rows
    total = max(1, epochs * len(own))
    for epoch in range(epochs):
        for t, k in enumerate(rng.permutation(len(own))):
            y, _, ids, x = own[k]
            rate = 0.5 * (1 - (epoch * len(own) + t) / total)
            mean = x @ table[ids]
            z = mean @ weights
            g = -np.exp(z - z.max())
            g /= -g.sum()
            g[y] += 1.0
            back = weights @ g
            weights += rate * 0.1 * np.outer(mean, g)
            table[ids] += (rate / (x @ x)) * np.outer(x, back)
    model = LanguageModel(languages, table, weights, bits=bits)
    if held:
        logits = np.array([x @ table[ids] @ weights for _, _, ids, x in held])
        _calibrate(model, logits, np.array([r[0] for r in held]),
                   np.array([1.0 / r[3].min() for r in held]), max_error)
    return model


def _calibrate(model: LanguageModel, logits, truth, sizes, max_error) -> None:
    """Temperature exp(a + b log n) of least log loss on a grid; then the threshold."""
    best = None
    for b in np.linspace(-0.6, 0.2, 17):
        for a in np.linspace(-4.0, 4.0, 65):
            model.temperature = (float(a), float(b))
            p = model.scored(logits * sizes[:, None], sizes)
            loss = -np.log(np.maximum(p[np.arange(len(p)), truth], 1e-12)).mean()
            if best is None or loss < best[0]:
                best = (loss, model.temperature)
    model.temperature = best[1]
    p = model.scored(logits * sizes[:, None], sizes)
    score, wrong = p.max(axis=1), p.argmax(axis=1) != truth
    order = np.argsort(-score, kind="stable")
    share = (np.cumsum(wrong[order]) + 1) / (np.arange(len(order)) + 1)
    passing = np.flatnonzero(share <= max_error)
    model.threshold = float(score[order[passing[-1]]]) if len(passing) else float(score.max())


def _windows(text: str, key: int, chars: int) -> list[str]:
    """The examples of one sampled document: its text (a window of a long one) and a short window."""
    out = []
    for size in (chars, SHORT_CHARS):
        at = key % (len(text) - size + 1) if len(text) > size else 0
        out.append(text[at:at + size])
    return out


def train_on_languages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                       usable: Column | None = None, n_docs: int = TRAIN_DOCS, n_chars: int = TRAIN_CHARS,
                       bits: int = BITS, **options) -> LanguageModel:
    """Fit on at most ``n_docs`` distinct texts with a language, of at most ``n_chars`` characters each.

    The sample goes round the languages: first the text of smallest hash of
    each, then the second, and so on, so a language (or a text with thousands
    of copies) that fills the table does not fill the sample; a language gives
    at most ``n_docs / SLOTS`` texts of each of its ``SLOTS`` hash parts. Rows without
    text or language, or not ``usable``, are left out. Only bucket counts of
    the sample reach the driver; without rows the model knows no language.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"),
                       F.col(f"`{lang}`").cast("string").alias("lang"),
                       (F.lit(True) if usable is None else usable).alias("usable"))
    rows = rows.where("usable and text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    slim = rows.groupBy("lang", "h").agg(F.min("id").alias("id")).withColumn("slot", F.pmod("h", F.lit(SLOTS)))

    def first(df, n, *keys):  # each task hands on the first rows of a group only
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        return df.withColumn("nth", nth).where(F.col("nth") <= n)

    few = first(slim, -(-n_docs // SLOTS), "lang", "slot")  # a language comes in parts, each with its share of the sample
    chosen = staged(first(few, n_docs, "lang").orderBy("nth", "lang").limit(n_docs)
                    .select("lang", "h", "id", "nth"), "language-sample")
    found = rows.join(F.broadcast(chosen.withColumnRenamed("id", "own_id")), ["lang", "h"]).where("id <=> own_id")

    def run(frames):
        for pdf in frames:
            out = []
            for t, name, h, nth in zip(pdf["text"], pdf["lang"], pdf["h"], pdf["nth"]):
                for k, part in enumerate(_windows(t, int(h), n_chars)):
                    ids, n = text_counts(part, bits)
                    out.append((name, int(h), int(nth), k, ids.astype("<u4").tobytes(), n.astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["lang", "h", "nth", "k", "ids", "n"])

    made = (map_frames(found.select("text", "lang", "h", "nth"), run,
                       "lang string, h long, nth int, k int, ids binary, n binary")
            .dropDuplicates(["lang", "h", "k"]).orderBy("nth", "lang", "k").collect())  # two rows a sampled text
    return fit([(r["lang"], r["nth"] - 1, np.frombuffer(r["ids"], "<u4").astype(np.int64),
                 np.frombuffer(r["n"], "<u4").astype(float)) for r in made], bits=bits, **options)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept from training: CRC-32 of the id as text leaves 2 mod 4 (a null id: not held out)."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, model: LanguageModel, *, doc_id: str = "doc_id", text: str = "text",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` per row of ``docs``, after the columns ``carry``.

    The prediction reads the text alone. A null or empty text, or one without
    a letter, is ``und`` with score 0 and rejected; a text of any length is
    read whole, in pieces of bounded size; equal texts are judged alike,
    repeated rows each give a row; a null ``doc_id`` stays null; an empty
    table gives an empty one; further columns are not read.
    """
    extra = carry or {}
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                       *[c.alias(n) for n, c in extra.items()])

    def run(frames):
        for pdf in frames:
            out = pdf.drop(columns="text")
            out["lang_pred"], out["score"], out["rejected"] = model.predict(pdf["text"].tolist())
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    carried = "".join(f", `{n}` {kinds[n]}" for n in extra)
    out = map_frames(rows, run, f"doc_id long{carried}, lang_pred string, score double, rejected boolean")
    return out
