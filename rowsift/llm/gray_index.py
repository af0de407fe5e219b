"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Fingerprints: words are runs of bytes other than ASCII white space, A-Z
lower-cased; every run of ``shingle`` words, joined by one space, is hashed by
XXH64 (seed 42); bit b of the fingerprint is set when over half the shingles
set it. A text with fewer words is one shingle, a text without words has
fingerprint zero.

Index. Two 64-bit fingerprints with at most three differing bits agree on one
of four 16-bit blocks, so each distinct fingerprint is listed four times,
rotated so that another block leads, and sorted by the Gray rank of the
rotated value: neighbours in that order differ in few bits, and equal leading
blocks are adjacent. The order is cut into nodes of at most ``NODE``
fingerprints, whatever the leading block, so no block is ever one task. A node
keeps the bit pattern all its members share (mask and values); its leaves, of
``LEAF`` members, keep the further bits that only they share. A search adds up
differences from the top: pairs of nodes whose shared bits differ too often
are dropped as tables, pairs of leaves inside a kept pair are dropped by node
plus leaf differences, and only the rest is compared bit by bit.

Nodes that hold the same leading block are paired by a join on that block.
Each pair of nodes gives back at most a spanning forest of its links (every
link stays represented, linked fingerprints stay connected), so a large group
of near copies costs rows in proportion to its members and not to its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_frames, staged, utf8
from .components import components

NODE = 1024
LEAF = 32
BANDS = 4
SEED = 42
#: Shingles hashed and counted at a time; bounds memory on very long texts.
PIECE = 1 << 16


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """SimHash of one UTF-8 text as an unsigned 64-bit number."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first = starts[:n].tolist()
    last = ends[-n:].tolist()
    del words
    digest = xxhash.xxh64_digest
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, n, PIECE):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[i:i + PIECE], last[i:i + PIECE])])
        votes += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                 row_key: str | None = None) -> DataFrame:
    """``(doc_id, fp)`` per row of ``docs``; ``fp`` is the fingerprint as a signed long.

    With ``row_key``, a column of any type, it is passed on as ``row_key``.
    """
    keyed = row_key is not None

    def run(frames):
        for pdf in frames:
            fps = np.fromiter((fingerprint(b, shingle) for b in utf8(pdf["text"])), dtype=np.uint64, count=len(pdf))
            made = pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps.view(np.int64)})
            yield made.assign(row_key=pdf["row_key"]) if keyed else made

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                       *([F.col(f"`{row_key}`").alias("row_key")] if keyed else []))
    more = f", row_key {rows.schema['row_key'].dataType.simpleString()}" if keyed else ""
    return map_frames(rows, run, "doc_id long, fp long" + more)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _rotated(fp: Column, bits: int) -> Column:
    if not bits:
        return fp
    return F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def _gray_rank(x: Column) -> Column:
    """Position of ``x`` in the 64-bit reflected Gray sequence (prefix parity)."""
    for step in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, step))
    return x


def _nodes(distinct: DataFrame) -> DataFrame:
    """Cut the Gray order of each band into nodes with their shared pattern."""
    unsigned = F.lit(-(1 << 63)).cast("long")
    listed = F.array(*[F.struct(F.lit(b).alias("band"), _rotated(F.col("fp"), 16 * b).alias("turned"))
                       for b in range(BANDS)])
    rows = (distinct.select(F.explode(listed).alias("e")).select("e.band", "e.turned")
            .select("band", "turned", _gray_rank(F.col("turned")).bitwiseXOR(unsigned).alias("rank"))
            .repartitionByRange("band", "rank").sortWithinPartitions("band", "rank")
            .select("band", "turned"))

    def run(frames):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        left_band, left = None, np.empty(0, dtype=np.int64)

        def node(band, fps):
            nonlocal made
            shared = ~(np.bitwise_or.reduce(fps) ^ np.bitwise_and.reduce(fps))
            made += 1
            keys = (fps.view(np.uint64) >> np.uint64(48)).astype(np.int64)
            return {"node": (part << 32) | made, "band": band, "first_key": int(keys[0]), "last_key": int(keys[-1]),
                    "mask": int(shared), "bits": int(fps[0] & shared), "fps": fps.tolist()}

        for pdf in frames:
            out = []
            bands, turned = pdf["band"].to_numpy(), pdf["turned"].to_numpy(dtype=np.int64)
            cuts = np.flatnonzero(np.diff(bands)) + 1
            for piece, at in zip(np.split(turned, cuts), np.concatenate(([0], cuts))):
                if not len(piece):
                    continue
                if left_band is not None and left_band != bands[at] and len(left):
                    out.append(node(left_band, left))
                    left = left[:0]
                left_band, left = int(bands[at]), np.concatenate((left, piece))
                while len(left) >= NODE:
                    out.append(node(left_band, left[:NODE]))
                    left = left[NODE:]
            if out:
                yield pd.DataFrame(out)
        if len(left):
            yield pd.DataFrame([node(left_band, left)])

    return map_frames(rows, run, "node long, band int, first_key long, last_key long, mask long, bits long, fps array<long>")


def _node_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs of different nodes that hold the same leading block and may hold a link."""
    slim = nodes.select("node", "band", "mask", "bits",
                        F.explode(F.array_distinct(F.array("first_key", "last_key"))).alias("key"))
    right = slim.select(F.col("node").alias("node2"), "band", F.col("mask").alias("mask2"),
                        F.col("bits").alias("bits2"), "key")
    differ = F.bit_count(F.col("bits").bitwiseXOR(F.col("bits2"))
                         .bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2")))
    return (slim.join(right, ["band", "key"]).where((F.col("node") < F.col("node2")) & (differ <= distance))
            .select("node", "node2").distinct())


def _leaves(fps: np.ndarray):
    """Members by leaf (the last leaf padded with its last member), shared mask and bits."""
    pad = -len(fps) % LEAF
    rows = np.concatenate((fps, np.repeat(fps[-1:], pad))).reshape(-1, LEAF)
    low = np.bitwise_and.reduce(rows, axis=1)
    mask = ~(np.bitwise_or.reduce(rows, axis=1) ^ low)
    return rows, mask, low & mask


def links_between(a: np.ndarray, b: np.ndarray, distance: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``a`` and ``b`` (uint64) at ``distance`` bits or fewer, found leaf by leaf."""
    rows_a, mask_a, bits_a = _leaves(a)
    rows_b, mask_b, bits_b = _leaves(b)
    top_a, top_b = np.bitwise_and.reduce(mask_a), np.bitwise_and.reduce(mask_b)
    # the node's own shared bits: those on which all its leaves agree as well
    top_a &= ~(np.bitwise_or.reduce(bits_a) ^ np.bitwise_and.reduce(bits_a))
    top_b &= ~(np.bitwise_or.reduce(bits_b) ^ np.bitwise_and.reduce(bits_b))
    upper = top_a & top_b
    above = int(np.bitwise_count((bits_a[0] ^ bits_b[0]) & upper))
    none = np.empty(0, dtype=np.uint64)
    if above > distance:
        return none, none
    further = mask_a[:, None] & mask_b[None, :] & ~upper
    total = above + np.bitwise_count((bits_a[:, None] ^ bits_b[None, :]) & further).astype(np.int64)
    if same:
        total[np.tril_indices(len(rows_a), -1)] = distance + 1
    left, right = np.nonzero(total <= distance)
    us, vs = [], []
    for i in range(0, len(left), 256):
        x, y = rows_a[left[i:i + 256]][:, :, None], rows_b[right[i:i + 256]][:, None, :]
        diff = x ^ y
        at = np.nonzero((np.bitwise_count(diff) <= distance) & (diff != 0))
        us.append(np.broadcast_to(x, diff.shape)[at])
        vs.append(np.broadcast_to(y, diff.shape)[at])
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges with the same connected components as the edges ``u``-``v``."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y = at[:len(u)], at[len(u):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(ids))
    return ids[far], ids[label[far]]


def _edges(nodes: DataFrame, distance: int) -> DataFrame:
    single = nodes.select("band", "fps", F.lit(None).cast("array<long>").alias("fps2"))
    pairs = _node_pairs(nodes, distance)
    double = (pairs.join(nodes.select("node", "band", "fps"), "node")
              .join(nodes.select(F.col("node").alias("node2"), F.col("fps").alias("fps2")), "node2")
              .select("band", "fps", "fps2"))

    def run(frames):
        for pdf in frames:
            us, vs = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.uint64)]
            for band, one, two in zip(pdf["band"], pdf["fps"], pdf["fps2"]):
                a = np.asarray(one, dtype=np.int64).view(np.uint64)
                b = a if two is None else np.asarray(two, dtype=np.int64).view(np.uint64)
                u, v = links_between(a, b, distance, two is None)
                if len(u) > len(a):
                    u, v = spanning(u, v)
                if band:  # back to the value before rotation
                    n, m = np.uint64(16 * band), np.uint64(64 - 16 * band)
                    u, v = (u >> n) | (u << m), (v >> n) | (v << m)
                us.append(u)
                vs.append(v)
            yield pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})

    schema = "u long, v long"
    return map_frames(single, run, schema).unionByName(map_frames(double, run, schema))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = 3, distance: int = 3, row_key: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id``.

    With ``row_key``, a column that tells rows apart, also ``row_key``
    and ``component``, which names the component whether its ids are null or not.

    ``component_id`` is the smallest ``doc_id`` reachable over links of
    ``distance`` or fewer differing bits, the row's own included. Rows with
    equal fingerprints are linked, also those without words. A null ``doc_id``
    never is the smallest; a component of null ids only has a null id.
    Repeated rows each give a row; an empty table gives an empty one; columns
    other than the two named are not read. ``distance`` is at most 3, the
    number of blocks less one.
    """
    if not 0 <= distance < BANDS:
        raise ValueError(f"distance must be 0 to {BANDS - 1}, got {distance}")
    rows = staged(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle, row_key=row_key), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    nodes = staged(_nodes(distinct), "nodes")
    linked = components(_edges(nodes, distance)).select(F.col("node").alias("fp"), "component")
    member = staged(distinct.join(linked, "fp", "left")
                    .select("fp", "least_id", F.coalesce("component", "fp").alias("component")), "members")
    least = member.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_fp = member.join(least, "component").select("fp", "component_id", "component")
    more = [] if row_key is None else ["row_key", "component"]
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id", *more)
