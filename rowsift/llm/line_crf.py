"""Quality rules by labelling lines: a linear-chain CRF and Viterbi decoding.

Each line (split at ``\\n``) that holds a word gets observations from its own
counts and its place in the document (length, symbols, capitals, digits,
repeated words, table bars, closing mark, an earlier copy of the line, the size of the document). A
two-state linear-chain conditional random field scores sequences of *content*
and *boilerplate* lines; Viterbi decoding picks the best one, and a document
is retained when content lines hold at least ``share`` of its words, whatever
its length, unless the base rules reject it.

The field is trained here by maximum conditional likelihood (forward-backward
gradients) on a bounded sample of labelled documents; their lines carry the
label of the document. ``TRAIN_DOCS`` documents, those of smallest hash, and
of each the first ``TRAIN_LINES`` lines are the documented bound of the
sample. Without labels of both kinds the fixed prior weights are used.

Counts come from every whole text: words are runs of bytes other than ASCII
white space. ``n_repeat_words`` counts the words inside a window of five words
that occurs at least twice in the text, by exact comparison.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames, utf8

TRAIN_DOCS = 2000
TRAIN_LINES = 40
#: Weight of the documents labelled good against those labelled bad: wrong rejections cost more.
GOOD_WEIGHT = 0.9
SHARE = 0.5
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

# observation templates: name and upper bounds of their bins (one more bin above)
BINS = (
    ("words", (1, 3, 8, 20)),
    ("mean_chars", (2.0, 4.0, 7.0, 12.0)),
    ("symbols", (0.0, 0.01, 0.05, 0.15)),
    ("capitals", (0.02, 0.15, 0.4)),
    ("digits", (0.0, 0.05, 0.2)),
    ("distinct", (0.25, 0.5, 0.8)),
    ("marks", (0.02, 0.06, 0.12)),
    ("closed", (0.5,)),
    ("copy", (0.5,)),
    ("edge", (0.5,)),
    ("document", (30.0, 200.0)),
)
OFFSETS = np.cumsum([0] + [len(b) + 1 for _, b in BINS])
N_OBS = int(OFFSETS[-1])
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_MARK = b"!?;:\"'()[]{}=+/\\@^~`_"
_CLOSE = b".!?:;\")"


def repeated_words(words: list[bytes]) -> int:
    """Words inside a ``WINDOW``-word window that occurs twice or more in ``words``."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    windows = ids[:n - WINDOW + 1].copy()
    for k in range(1, WINDOW):  # renumber after each word: exact, and never overflows
        _, windows = np.unique(windows * len(seen) + ids[k:n - WINDOW + 1 + k], return_inverse=True)
    twice = np.bincount(windows)[windows] > 1
    if not twice.any():
        return 0
    cover = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def observe(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Observations of the lines with a word, their word counts, and the number of repeated lines."""
    raw, counts, seen, dup = [], [], set(), 0
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        again = line in seen
        seen.add(line)
        dup += again
        chars = size - line.count(b" ")
        raw.append((n, chars / n,
                    (size - len(line.translate(None, SYMBOLS))) / size,
                    (size - len(line.translate(None, _UPPER))) / size,
                    (size - len(line.translate(None, _DIGIT))) / size,
                    len(set(words)) / n,
                    (size - len(line.translate(None, _MARK))) / size,
                    words[-1][-1:] in _CLOSE, again, 0.0, 0.0))
        counts.append(n)
    if not raw:
        return np.empty((0, len(BINS)), dtype=np.int64), np.empty(0, dtype=np.int64), 0
    values = np.array(raw, dtype=np.float64)
    values[0, -2] = values[-1, -2] = 1.0
    values[:, -1] = sum(counts)
    obs = np.empty(values.shape, dtype=np.int64)
    for k, (_, bounds) in enumerate(BINS):
        obs[:, k] = OFFSETS[k] + np.searchsorted(np.array(bounds), values[:, k], side="left")
    return obs, np.array(counts, dtype=np.int64), dup


# ---- the field: weights are emission (N_OBS, 2), transition (2, 2); state 1 is content

def prior_weights() -> dict:
    """Used when there is nothing to train on: symbols, repeats and copies speak against a line."""
    emission = np.zeros((N_OBS, 2))
    at = {name: int(OFFSETS[k]) for k, (name, _) in enumerate(BINS)}
    emission[:, 1] += 0.1
    for name, bins in (("symbols", (3, 4)), ("capitals", (3,)), ("distinct", (0,)), ("digits", (3,)), ("copy", (1,))):
        for b in bins:
            emission[at[name] + b, 0] += 3.0
    return {"emission": emission.tolist(), "transition": [[1.0, 0.0], [0.0, 1.0]]}


def viterbi(scores: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best state sequence for line scores (n, 2); ties go to content."""
    n = len(scores)
    if not n:
        return np.empty(0, dtype=np.int64)
    (t00, t01), (t10, t11) = transition.tolist()
    rows = scores.tolist()
    a, b = rows[0]
    back = []
    for s0, s1 in rows[1:]:
        from0, from1 = b + t10 >= a + t00, b + t11 >= a + t01
        back.append((from0, from1))
        a, b = (b + t10 if from0 else a + t00) + s0, (b + t11 if from1 else a + t01) + s1
    state = int(b >= a)
    path = [state]
    for step in reversed(back):
        state = int(step[state])
        path.append(state)
    return np.array(path[::-1], dtype=np.int64)


def train(sequences: list[np.ndarray], labels: list[int], rounds: int = 60, rate: float = 0.7,
          penalty: float = 1e-3) -> dict:
    """Conditional maximum likelihood by gradient ascent with forward-backward marginals.

    Sequences are padded into one table; good documents weigh ``GOOD_WEIGHT``
    of all. The result does not depend on the order of ties: everything is a sum.
    """
    keep = [i for i, s in enumerate(sequences) if len(s)]
    sequences, y = [sequences[i] for i in keep], np.array([labels[i] for i in keep])
    if not len(y) or y.min() == y.max():
        return prior_weights()
    size = np.array([len(s) for s in sequences])
    d, top = len(y), int(size.max())
    obs = np.full((d, top, len(BINS)), N_OBS, dtype=np.int64)
    for i, s in enumerate(sequences):
        obs[i, :len(s)] = s
    live = np.arange(top)[None, :] < size[:, None]
    weight = np.where(y == 1, GOOD_WEIGHT / (y == 1).sum(), (1 - GOOD_WEIGHT) / (y == 0).sum()) / size
    em, tr = np.zeros((N_OBS + 1, 2)), np.zeros((2, 2))
    gold = np.zeros((d, top, 2))
    gold[np.arange(d), :, y] = 1.0
    gold *= live[:, :, None]
    step_em, step_tr = np.zeros_like(em), np.zeros_like(tr)
    for _ in range(rounds):
        sc = em[obs].sum(axis=2)
        fwd, bwd = np.zeros((d, top, 2)), np.zeros((d, top, 2))
        fwd[:, 0] = sc[:, 0]
        for t in range(1, top):
            m = np.logaddexp(fwd[:, t - 1, 0, None] + tr[0], fwd[:, t - 1, 1, None] + tr[1]) + sc[:, t]
            fwd[:, t] = np.where(live[:, t, None], m, fwd[:, t - 1])
        for t in range(top - 2, -1, -1):
            nxt = sc[:, t + 1] + bwd[:, t + 1]
            m = np.logaddexp(nxt[:, 0, None] + tr[:, 0], nxt[:, 1, None] + tr[:, 1])
            bwd[:, t] = np.where(live[:, t + 1, None], m, 0.0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        marg = np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None]
        diff = (gold - marg) * weight[:, None, None]
        g_em = np.zeros_like(em)
        for k in range(len(BINS)):
            for s in (0, 1):
                g_em[:, s] += np.bincount(obs[:, :, k].ravel(), weights=diff[:, :, s].ravel(), minlength=N_OBS + 1)
        g_tr = np.zeros_like(tr)
        both = live[:, 1:] * weight[:, None]
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(fwd[:, :-1, a] + tr[a, b] + sc[:, 1:, b] + bwd[:, 1:, b] - z[:, None])
                g_tr[a, b] = ((gold[:, :-1, a] * gold[:, 1:, b] - p) * both).sum()
        g_em[N_OBS] = 0
        step_em = 0.9 * step_em + g_em - penalty * em
        step_tr = 0.9 * step_tr + g_tr - penalty * tr
        em, tr = em + rate * step_em, tr + rate * step_tr
    return {"emission": em[:N_OBS].tolist(), "transition": tr.tolist()}


def train_on_labels(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                    quality: str = "quality", n_docs: int = TRAIN_DOCS, n_lines: int = TRAIN_LINES) -> dict:
    """Fit the field on at most ``n_docs`` labelled documents (smallest hash of the id).

    Only observations of at most ``n_lines`` lines per document reach the
    driver, as small integers; null ids, null labels and labels other than 0
    and 1 are left out.
    """
    marked = (labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{quality}`").cast("int").alias("y"))
              .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
              .groupBy("doc_id").agg(F.max("y").alias("y")))
    rank = F.xxhash64("doc_id")
    chosen = (marked.orderBy(rank, "doc_id").limit(n_docs))  # the documented sample bound
    rows = (docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
            .join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text"))

    def run(frames):
        for pdf in frames:
            obs = [json.dumps(observe(b)[0][:n_lines].tolist()) for b in utf8(pdf["text"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "obs": obs})

    got = (map_frames(rows, run, "doc_id long, y int, obs string")
           .orderBy("doc_id", "obs").limit(n_docs).collect())
    sequences = [np.array(json.loads(r["obs"]), dtype=np.int64).reshape(-1, len(BINS)) for r in got]
    return train(sequences, [r["y"] for r in got])


def judge_lines(docs: DataFrame, weights: dict, *, doc_id: str = "doc_id", text: str = "text",
                share: float = SHARE, keep_columns: bool = False) -> DataFrame:
    """One row of figures per row of ``docs``.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, content_share, base_failed, kept``; with ``keep_columns`` the
    columns of ``docs`` instead, rejected rows left out. A null text has no
    words and fails the base rules (fewer than ten words); a null ``doc_id``
    stays null; repeated rows are judged alike; a text of any length is judged
    by all its lines, with memory in proportion to it; an empty table gives an
    empty one; further columns are not read.
    """
    emission = np.array(weights["emission"])
    transition = np.array(weights["transition"])

    def figures(data: bytes) -> tuple:
        words = data.split()
        n = len(words)
        obs, counts, dup = observe(data)
        # a code point is a byte that does not continue another
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        chars = int(((flat & 0xC0) != 0x80).sum())
        symbols = len(data) - len(data.translate(None, SYMBOLS))
        repeat = repeated_words(words)
        states = viterbi(emission[obs].sum(axis=1), transition)
        content = float((counts * states).sum() / n) if n else 0.0
        failed = n < 10 or 100 * repeat > 20 * n
        return n, chars, symbols, dup, repeat, len(counts), content, failed, not failed and content >= share

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
             "content_share", "base_failed", "kept"]
    if keep_columns:
        def keep(frames):
            for pdf in frames:
                yield pdf[np.fromiter((figures(b)[-1] for b in utf8(pdf[text])), dtype=bool, count=len(pdf))]

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return map_frames(docs, keep, schema)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(frames):
        for pdf in frames:
            made = pd.DataFrame([figures(b) for b in utf8(pdf["text"])], columns=names)
            yield pd.concat((pdf[["doc_id"]].reset_index(drop=True), made), axis=1)

    return map_frames(rows, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                 "n_repeat_words long, n_lines long, content_share double, base_failed boolean, kept boolean")
