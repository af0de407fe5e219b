"""Byte-level BPE with a segment tree over byte positions.

A piece of text (one match of the pre-tokenizer pattern) starts as its bytes.
Leaf ``i`` of the tree holds the rank of the pair formed by the live token at
byte ``i`` and its right neighbour, inner nodes the leftmost smallest rank
below them, so the root names the next merge. A merge changes three leaves:
the token that grew, its left neighbour and the token that vanished; each is a
point update along one path, so a piece of n bytes costs O(n log n) however
long it is. Short pieces are merged many at a time, one tree per row of a
numpy table and one merge per tree and step; long ones get a tree of their own.

Text is handled in blocks of bounded size. Within a block it is first cut
before each blank that follows a character other than white space: no match
of a pattern that takes at most one leading blank crosses such a place, and
the units between repeat, so a worker remembers the ids of recent ones in two
tables of bounded size. Spark splits the documents over tasks; the vocabulary
travels with the function as the bytes of its file.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_frames

#: Units whose ids a Python worker remembers (twice: recent and older), and the longest.
REMEMBERED = 250_000
REMEMBERED_CHARS = 64
#: Characters of text and units handled at a time; bounds memory on long texts.
BLOCK_CHARS = 1 << 20
BLOCK = 1 << 17
#: Characters of text whose results leave a task together; bounds the rows in flight.
FRAME_CHARS = 4 << 20
#: Bytes up to which pieces are merged together in a table.
SHORT = 32

_NONE = 1 << 62
_CUT = re.compile(r"(?<=\S)(?= )")


class BpeTree:
    """Encoder and decoder for one rank file (base64 token, blank, rank per line)."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(None, rank_file.splitlines()))}
        self.ranks = ranks
        top = max(ranks.values(), default=0) + 1
        self.tokens: list = [None] * top
        for token, r in ranks.items():
            self.tokens[r] = token
        self.pattern = regex.compile(pattern)
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        # every pair of tokens whose bytes together are a token: (left, right) -> its rank
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t))
                 if t[:k] in ranks and t[k:] in ranks}
        order = np.array(sorted(pairs), dtype=np.int64)
        self._pair_keys = np.append(order, np.int64(_NONE))
        self._pair_rank = np.array([pairs[k] for k in order.tolist()] + [0], dtype=np.int64)
        self._byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        # the rank of two neighbouring bytes, where every piece starts; -1: no token
        self._first = np.full((256, 256), -1, dtype=np.int64)
        for t, r in ranks.items():
            if len(t) == 2:
                self._first[t[0], t[1]] = r
        digits = [str(i).encode() for i in range(top)]
        width = max(map(len, digits), default=1) + 1
        cells = np.frombuffer(b"".join((b" " + d).rjust(width, b"\0") for d in digits), dtype=np.uint8)
        self._digits = cells.reshape(-1, width)

    # ---- merging

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: always the leftmost pair of smallest rank merges next."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None or not n:
            return [whole] if n else []
        size = 1 << (n - 1).bit_length()
        # a node holds rank * size + position: the minimum is the leftmost smallest rank
        tree = [_NONE] * (2 * size)
        end = list(range(1, n + 1))        # where the live token that starts here ends
        before = list(range(-1, n))        # start of the live token to the left
        for i in range(n - 1):
            r = ranks.get(piece[i:i + 2])
            if r is not None:
                tree[size + i] = r * size + i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        while tree[1] != _NONE:
            i = tree[1] % size
            gone = end[i]
            end[i] = stop = end[gone]
            if stop < n:
                before[stop] = i
            changes = [(gone, _NONE)]
            r = ranks.get(piece[i:end[stop]]) if stop < n else None
            changes.append((i, _NONE if r is None else r * size + i))
            h = before[i]
            if h >= 0:
                r = ranks.get(piece[h:stop])
                changes.append((h, _NONE if r is None else r * size + h))
            for at, value in changes:
                k = size + at
                if tree[k] == value:
                    continue
                tree[k] = value
                while k > 1:
                    a = tree[k ^ 1]
                    low = a if a < value else value
                    k >>= 1
                    if tree[k] == low:
                        break
                    tree[k] = value = low
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def _pair(self, left: np.ndarray, right: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
        """Leaf values for pairs of token ids: rank * size + position, or none."""
        key = (left << 32) | right
        k = np.searchsorted(self._pair_keys, key)
        return np.where(self._pair_keys[k] == key, self._pair_rank[k] * size + at, _NONE)

    def _merge_table(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids (little-endian int32) of pieces of at most ``size`` bytes, a power of two."""
        rows, cols = len(pieces), np.arange(size)
        raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), dtype=np.uint8).reshape(rows, size)
        n = np.fromiter(map(len, pieces), dtype=np.int64, count=rows)
        token = self._byte_id[raw]
        after = np.tile(cols + 1, (rows, 1))
        before = np.tile(cols - 1, (rows, 1))
        live = cols < n[:, None]
        tree = np.full((rows, 2 * size), _NONE, dtype=np.int64)
        rank = self._first[raw[:, :-1], raw[:, 1:]]
        tree[:, size:2 * size - 1] = np.where(live[:, 1:] & (rank >= 0), rank * size + cols[:-1], _NONE)
        k = size >> 1
        while k:
            np.minimum(tree[:, 2 * k:4 * k:2], tree[:, 2 * k + 1:4 * k:2], out=tree[:, k:2 * k])
            k >>= 1
        act = np.flatnonzero(tree[:, 1] != _NONE)
        while len(act):
            root = tree[act, 1]
            i, rank = root % size, root // size
            gone = after[act, i]
            stop = after[act, gone]
            token[act, i] = rank
            after[act, i] = stop
            live[act, gone] = False
            tree[act, size + gone] = _NONE
            more = stop < n[act]
            ends = np.minimum(stop, size - 1)
            tree[act, size + i] = np.where(more, self._pair(rank, token[act, ends], size, i), _NONE)
            before[act[more], stop[more]] = i[more]
            h = before[act, i]
            has = h >= 0
            rows_h, h = act[has], h[has]
            tree[rows_h, size + h] = self._pair(token[rows_h, h], rank[has], size, h)
            for r, at in ((act, gone), (act, i), (rows_h, h)):
                k = (size + at) >> 1
                while len(k) and k[0]:
                    tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
                    k = k >> 1
            act = act[tree[act, 1] != _NONE]
        flat = token[live].astype("<i4").tobytes()
        cuts = np.concatenate(([0], np.cumsum(live.sum(axis=1) * 4))).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge_many(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Piece -> ids (little-endian int32) for different pieces."""
        out, sized = {}, {}
        for p in pieces:
            whole = self.ranks.get(p)
            if whole is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(p) > SHORT:
                out[p] = np.array(self.merge(p), dtype="<i4").tobytes()
            else:
                sized.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(p)
        for size, group in sized.items():
            for i in range(0, len(group), 1 << 14):
                part = group[i:i + (1 << 14)]
                out.update(zip(part, self._merge_table(part, size)))
        return out

    # ---- texts

    def _learn(self, units: set[str]) -> None:
        """Put the ids of all ``units`` into the table of recent ones."""
        if len(self._new) + len(units) > REMEMBERED:
            self._old, self._new = self._new, {}
        new, old, find = self._new, self._old, self.pattern.findall
        fresh = units - new.keys()
        again = old.keys() & fresh
        new.update({u: old[u] for u in again})
        fresh = list(fresh - again)
        # Units that begin with a blank and end with another character keep their
        # bounds side by side, so one pass of the pattern cuts them all.
        plain = [u for u in fresh if u[0] == " " and not u[-1].isspace()]
        odd = [u for u in fresh if u[0] != " " or u[-1].isspace()]
        pieces = find("".join(plain))
        stops = np.searchsorted(np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))),
                                np.cumsum(np.fromiter(map(len, plain), dtype=np.int64, count=len(plain)))) + 1
        counts = np.diff(stops, prepend=0).tolist()
        for u in odd:
            more = find(u)
            pieces += more
            counts.append(len(more))
        known = self._known(pieces)
        ids = iter(list(map(known.__getitem__, pieces)))
        new.update(zip(chain(plain, odd), [b"".join(islice(ids, n)) for n in counts]))

    def _known(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each different piece."""
        different = list(set(pieces))
        raw = [p.encode("utf-8", "surrogatepass") for p in different]
        merged = self.merge_many(raw)
        return dict(zip(different, map(merged.__getitem__, raw)))

    def encode_texts(self, texts) -> Iterator[tuple[int, np.ndarray]]:
        """``(position, ids)`` of texts in order; a long text comes in several parts."""
        waiting, size = [], 0

        def flush():
            units = set().union(*[us for _, us in waiting])
            self._learn(units)
            ids = self._new.__getitem__
            for at, us in waiting:
                yield at, np.frombuffer(b"".join(map(ids, us)), dtype="<i4")
            for u in units:
                if len(u) > REMEMBERED_CHARS:
                    del self._new[u]

        for at, text in enumerate(texts):
            if not isinstance(text, str) or not text:
                continue
            for us in _units(text):
                waiting.append((at, us))
                size += len(us) + len(text) // 64
                if size >= BLOCK:
                    yield from flush()
                    waiting, size = [], 0
        yield from flush()

    def encode(self, text: str | None) -> np.ndarray:
        parts = [ids for _, ids in self.encode_texts([text])]
        return np.concatenate(parts) if parts else np.empty(0, dtype="<i4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, each after a blank."""
        cells = self._digits[ids].ravel()
        return cells[cells != 0].tobytes()


def _units(text: str) -> Iterator[list[str]]:
    """Cut a text into units that no match crosses, some at a time (see the module's notes)."""
    if len(text) <= BLOCK_CHARS:
        yield _CUT.split(text)
        return
    start = 0
    while start < len(text):
        stop = start + BLOCK_CHARS
        while stop < len(text) and not _CUT.match(text, stop):
            stop += 1
        yield _CUT.split(text[start:stop])
        start = stop


def _slices(frames, text: str) -> Iterator[pd.DataFrame]:
    """Arrow batches cut into frames of about ``FRAME_CHARS`` characters of text."""
    for pdf in frames:
        size = pdf[text].str.len().fillna(0).to_numpy(dtype=np.int64).cumsum() if len(pdf) else np.empty(0, dtype=np.int64)
        at = 0
        while at < len(pdf):
            done = int(size[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(size, done + FRAME_CHARS, side="right")))
            yield pdf.iloc[at:stop].reset_index(drop=True)
            at = stop


_WORKER: dict = {}


def tokenizer(rank_file: bytes, pattern: str) -> BpeTree:
    """The tokenizer of this Python worker (the last one asked for is kept)."""
    key = (hashlib.sha1(rank_file).digest(), pattern)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = BpeTree(rank_file, pattern)
    return _WORKER[key]


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read where the driver runs (about a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def _clashless(docs: DataFrame, made: list[str]) -> DataFrame:
    taken = {m.lower() for m in made}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])


def encode_documents(docs: DataFrame, *, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>`` and ``n_tokens long``.

    A null text is empty and has no ids. Columns of ``docs`` that bear one of
    the two new names are replaced. Special tokens are never produced: their
    spelling in a text is ordinary text.
    """
    rank_file = read_ranks(rank_path)
    rest = _clashless(docs, ["ids", "n_tokens", "_bpe_text"])
    names = rest.columns
    rows = rest.select(*[F.col(f"`{c}`") for c in names]) if text in names else None
    if rows is None:
        raise ValueError(f"no text column {text!r}")

    def run(frames):
        bpe = tokenizer(rank_file, pattern)
        for pdf in _slices(frames, text):
            parts: list[list] = [[] for _ in range(len(pdf))]
            for at, ids in bpe.encode_texts(pdf[text]):
                parts[at].append(ids)
            ids = [np.concatenate(p) if p else np.empty(0, dtype="<i4") for p in parts]
            yield pdf.assign(ids=ids, n_tokens=[len(x) for x in ids])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_frames(rows, run, f"{schema}, ids array<int>, n_tokens long")


def count_tokens(docs: DataFrame, column: str, *, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs``, unchanged, with the number of ids of each text as ``column`` (long; a null text: 0)."""
    rank_file = read_ranks(rank_path)

    def run(batches):
        import pyarrow as pa

        bpe = tokenizer(rank_file, pattern)
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            for at, ids in bpe.encode_texts(batch.column(text).to_pylist()):
                n[at] += len(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=[*batch.schema.names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, run, f"{fields}, `{column}` long")


def decode_documents(rows: DataFrame, *, rank_path: str, pattern: str, key: str, ids: str = "ids") -> DataFrame:
    """``key`` and ``decoded binary``: the bytes that the ids stand for (null ids: no bytes)."""
    rank_file = read_ranks(rank_path)
    slim = rows.select(F.col(f"`{key}`").alias("k"), F.col(f"`{ids}`").alias("ids"))
    kind = slim.schema["k"].dataType.simpleString()

    def run(frames):
        bpe = tokenizer(rank_file, pattern)
        for pdf in frames:
            yield pd.DataFrame({"k": pdf["k"], "decoded": [bpe.decode([] if x is None else x.tolist()) for x in pdf["ids"]]})

    return map_frames(slim, run, f"k {kind}, decoded binary").withColumnRenamed("k", key)


def token_digests(docs: DataFrame, *, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """Encode and decode every text; one row of figures per row of ``docs``.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``: the number of ids, the
    SHA-256 of the decimal ids joined by one space, and that of the bytes the
    ids decode to; ``with_ids`` adds ``ids array<int>``. A null text is empty;
    a null ``doc_id`` stays null; repeated rows each give a row; an empty table
    gives an empty one; other columns are not read. Without ``with_ids`` long
    texts go through in blocks, so a task holds one text and one block of ids.
    """
    rank_file = read_ranks(rank_path)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(frames):
        bpe = tokenizer(rank_file, pattern)
        for pdf in _slices(frames, "text"):
            sums = [[0, hashlib.sha256(), hashlib.sha256(), []] for _ in range(len(pdf))]
            for at, ids in bpe.encode_texts(pdf["text"]):
                row = sums[at]
                listed = bpe.decimal(ids)
                row[1].update(listed if row[0] else listed[1:])
                row[2].update(bpe.decode(ids.tolist()))
                row[0] += len(ids)
                if with_ids:
                    row[3].append(ids)
            made = pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [r[0] for r in sums],
                                 "ids_sha256": [r[1].hexdigest() for r in sums],
                                 "decoded_sha256": [r[2].hexdigest() for r in sums]})
            if with_ids:
                made["ids"] = [np.concatenate(r[3]) if r[3] else np.empty(0, dtype="<i4") for r in sums]
            yield made

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_frames(rows, run, schema + ", ids array<int>" * with_ids)
