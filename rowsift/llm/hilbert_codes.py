"""Vector code compression: product codes fitted on Hilbert-sorted blocks.

A vector is cut into equal parts, and each part is replaced by the number of
its nearest codebook entry. Codebooks are fitted by rounds of assigning and
averaging, all in integers.

The parts of all vectors are sorted once along a Hilbert curve through their
space, position by position, and stored as flat blocks of up to ``BLOCK``
parts. A block also stores its box (smallest and largest value per component)
and its component sums. In each round the distances of a box to the entries
give the block's shortlist: an entry whose least distance to the box exceeds
the least of all largest distances cannot be nearest for any part in it. A
block with one entry on its shortlist goes to it whole, by its stored sums; any
other is settled by a small exact integer kernel over its shortlist, ties to
the lower number. Neighbours on the curve lie close, so boxes are small.

Blocks are cut from range partitions by (position, curve, row), so thousands
of equal vectors spread like others. Each round reads the written blocks and
hands on one sum per entry and task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames, staged
from .int_vectors import finite, floor_means, floored, partial_frame, squared_distances, stacked, summed

BLOCK = 256
#: Label sums are sent to all executors up to this number of labels; beyond, both sides shuffle.
BROADCAST_LABELS = 1_000_000
#: Bits of a place on the curve, and the most components it goes through.
KEY_BITS, KEY_DIMS = 62, 31


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with ``bits`` bits per component.

    The axes are turned into the transposed index (Gray decoding of the bits,
    then undoing the excess rotations), whose bits are interleaved."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def shortlist(lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Numbers of the entries that can be nearest to a point of the box, ascending."""
    below, above = lo - entries, entries - hi
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(below), np.abs(above))
    return np.flatnonzero((near ** 2).sum(1) <= (far ** 2).sum(1).min())


def settle(points: np.ndarray, lo, hi, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and exact squared distance of each point of a block."""
    short = shortlist(lo, hi, entries)
    d = squared_distances(points, entries[short])
    first = d.argmin(axis=1)
    return short[first], d[np.arange(len(d)), first]


def _box(kept: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each component; a row per component reaches the driver."""
    def run(frames):
        lo = hi = None
        for pdf in frames:
            if len(pdf):
                v = stacked(pdf["v"], dims)
                lo = v.min(0) if lo is None else np.minimum(lo, v.min(0))
                hi = v.max(0) if hi is None else np.maximum(hi, v.max(0))
        if lo is not None:
            yield pd.DataFrame({"pos": np.arange(dims, dtype=np.int32), "lo": lo, "hi": hi})

    rows = (map_frames(kept.select("v"), run, "pos int, lo long, hi long")
            .groupBy("pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("pos").collect())
    return np.array([r["lo"] for r in rows], np.int64), np.array([r["hi"] for r in rows], np.int64)


def sorted_blocks(kept: DataFrame, dims: int, parts: int, block: int = BLOCK) -> DataFrame:
    """``part, n, lo, hi, sums, rows, points`` from rows ``row, v``; written once."""
    p = dims // parts
    shown = min(p, KEY_DIMS)
    bits = min(16, KEY_BITS // shown)
    lo, hi = _box(kept, dims)
    width = np.maximum(hi - lo, 1)

    def cut(frames):
        for pdf in frames:
            v = stacked(pdf["v"], dims)
            cells = (v - lo) * ((1 << bits) - 1) // width
            for k in range(parts):
                own = v[:, k * p:(k + 1) * p].astype("<i4")
                yield pd.DataFrame({"part": np.full(len(v), k, np.int32),
                                    "key": hilbert_keys(cells[:, k * p:k * p + shown], bits),
                                    "row": pdf["row"].array, "point": [x.tobytes() for x in own]})

    def pack(frames):
        part, rows, points = None, [], []

        def flush():
            v = np.frombuffer(b"".join(points), "<i4").reshape(-1, p)
            return part, len(v), v.min(0).tolist(), v.max(0).tolist(), v.sum(0, dtype=np.int64).tolist(), \
                np.array(rows, "<i8").tobytes(), v.tobytes()

        def frame(out):
            return pd.DataFrame(out, columns=["part", "n", "lo", "hi", "sums", "rows", "points"])

        for pdf in frames:
            out = []
            for k, row, point in zip(pdf["part"], pdf["row"], pdf["point"]):
                if rows and (k != part or len(rows) == block):
                    out.append(flush())
                    rows, points = [], []
                part = k
                rows.append(row)
                points.append(point)
            yield frame(out)
        if rows:
            yield frame([flush()])

    cutted = staged(map_frames(kept.select("row", "v"), cut, "part int, key long, row long, point binary"), "vector-parts")
    ordered = cutted.repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row")
    return staged(map_frames(ordered, pack, "part int, n int, lo array<int>, hi array<int>, sums array<long>, "
                                            "rows binary, points binary"), "vector-blocks")


def _points(data: bytes, p: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(-1, p).astype(np.int64)


def refine(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round over all blocks: floored means of the parts of each entry; an unused entry stays."""
    parts, entries, p = books.shape

    def run(frames):
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, p), np.int64)
        for pdf in frames:
            for k, size, lo, hi, total, data in zip(pdf["part"], pdf["n"], pdf["lo"], pdf["hi"], pdf["sums"], pdf["points"]):
                short = shortlist(np.asarray(lo, np.int64), np.asarray(hi, np.int64), books[k])
                if len(short) == 1:  # the whole block, by its stored sums
                    n[k, short[0]] += size
                    sums[k, short[0]] += np.asarray(total, np.int64)
                    continue
                points = _points(data, p)
                who = short[squared_distances(points, books[k][short]).argmin(axis=1)]
                for e in np.unique(who):
                    mine = points[who == e]
                    n[k, e] += len(mine)
                    sums[k, e] += mine.sum(0)
        yield partial_frame(["part", "entry"], [(k, e, int(n[k, e]), sums[k, e].tolist()) for k, e in zip(*np.nonzero(n))])

    out = books.copy()
    for (k, e), (n, sums) in summed(blocks.select("part", "n", "lo", "hi", "sums", "points"), run, "part int, entry int").items():
        out[k, e] = floor_means(n, sums)
    return out


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``row, part, entry, distance`` of every part of every block."""
    p = books.shape[2]

    def run(frames):
        for pdf in frames:
            for k, lo, hi, rows, data in zip(pdf["part"], pdf["lo"], pdf["hi"], pdf["rows"], pdf["points"]):
                who, d = settle(_points(data, p), np.asarray(lo, np.int64), np.asarray(hi, np.int64), books[k])
                yield pd.DataFrame({"row": np.frombuffer(rows, "<i8"), "part": np.full(len(who), k, np.int32),
                                    "entry": who.astype(np.int32), "distance": d})

    return map_frames(blocks.select("part", "lo", "hi", "rows", "points"), run, "row long, part int, entry int, distance long")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def common_length(vectors: DataFrame, parts: int) -> int | None:
    """The length most vectors have among positive multiples of ``parts`` (ties: the smaller)."""
    sizes = vectors.groupBy(F.size("e").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % parts == 0))
    top = sizes.orderBy(F.col("count").desc(), "n").first()
    return top["n"] if top else None


def compress(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
             dims: int | None = None, block: int = BLOCK, vec_id: str = "vec_id", vector: str = "embedding",
             label: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` per kept vector.

    Dropped are vectors that are null or hold a null or non-finite component;
    also, as they cannot be cut into ``parts`` equal parts and compared, those
    of another length than ``dims`` (default: the most common length that
    ``parts`` divides). Components become floor(scale * x). The codebooks start
    as the parts of the ``entries`` smallest ids (null ids last, equal ids by
    their vectors; fewer vectors give fewer entries). A code has two hex digits
    per part. ``label_error`` adds up the errors of equal labels, null ones
    together. Repeated rows each give a row; a null id stays null; further
    columns are not read; an empty table gives an empty one. The driver
    receives codebooks, component ranges and the first ``entries`` vectors.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits has 1 to 256 entries")
    given = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"),
                           F.col(f"`{vector}`").alias("e")).where(finite("e"))
    dims = dims or common_length(given, parts) or parts
    if dims % parts:
        raise ValueError(f"{dims} components cannot be cut into {parts} equal parts")
    kept = staged(given.where(F.size("e") == dims)
                  .select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", floored("e", scale, dims).alias("v")),
                  "integer-vectors")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = stacked([r["v"] for r in first], dims).reshape(-1, parts, dims // parts).transpose(1, 0, 2)
    own = kept.select("row", "vec_id", "label")
    if first:
        blocks = sorted_blocks(kept, dims, parts, block)
        for _ in range(rounds):
            books = refine(blocks, books)
        coded = encode(blocks, books)
    else:
        coded = own.select("row", F.lit(0).alias("part"), F.lit(0).alias("entry"), F.lit(0).cast("long").alias("distance")).limit(0)
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == k, F.col("entry"))))), 2, "0") for k in range(parts)]
    lines = own.withColumn("own", F.lit(True)).unionByName(coded, allowMissingColumns=True)
    mine = F.col("own").isNotNull()
    made = staged(lines.groupBy("row").agg(
        F.max(F.when(mine, F.col("vec_id"))).alias("vec_id"), F.first(F.when(mine, F.col("label")), ignorenulls=True).alias("label"),
        F.concat(*digits).alias("code"), F.sum("distance").alias("error")).drop("row"), "vector-codes")
    sums = staged(made.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    few = sums.count() <= BROADCAST_LABELS  # measured, not assumed
    sums = sums.withColumnRenamed("label", "_label")
    out = made.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
