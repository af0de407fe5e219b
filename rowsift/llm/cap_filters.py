"""Near-duplicate vectors by locality-sensitive spherical-cap filters.

Vectors are scaled to unit length. A structured random code turns them by a
random rotation and cuts them into ``BLOCKS`` equal parts with some unit
vectors, the words, for each; a filter is one word from each part and its
direction their concatenation, so a few dozen words stand for a thousand
directions. A vector belongs to every filter whose direction it exceeds (inner
product at least the cut), and in any case to the best filter of each code.
List decoding goes through the parts in order and follows only sums that can
still reach the cut. ``CODES`` independent codes level out the number of
filters per vector.

Vectors that share a filter (and a label) meet in a join on it; a pair is then
verified by its cosine in double precision. A pair that shares several filters
is counted in the smallest of them only, which both members can tell from
their lists, so pairs are never written out to be made distinct: each block
comparison gives back the number of links per vector and a spanning forest.
Filters with many vectors are dealt into blocks of about ``BLOCK_ROWS`` and
compared block by block, so a hot filter is many bounded tasks.

Codes are sized by the label: a label of n vectors gets so many words that a
filter holds about ``PER_FILTER`` of them, and the cut is set so that a vector
is in about ``PER_VECTOR`` filters. So the work per vector is the same in a
label of any size. A pair at the threshold shares none of its filters with a
probability that falls exponentially with the filters per vector; the recall
measured against brute force is in the README.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_frames, staged
from .components import components
from .gray_index import spanning

THRESHOLD = 0.93
CODES = 8
BLOCKS = 2
#: Filters that a vector is in, and vectors that a filter holds, on average.
PER_VECTOR = 36
PER_FILTER = 128
LEAST_WORDS = 4
SEED = 20
BLOCK_ROWS = 512
#: From so many links in a block on, their lists are compared by a matrix product.
MANY_PAIRS = 2048
#: Label sizes are sent to all executors up to this number of labels (measured).
BROADCAST_LABELS = 1_000_000


def words_for(size: int, *, codes: int = CODES, blocks: int = BLOCKS) -> int:
    """Words per part for a label of ``size`` vectors (steps of about a fifth, so few codes are made)."""
    wanted = (max(size, 1) * PER_VECTOR / (codes * PER_FILTER)) ** (1 / blocks)
    step = max(0, math.ceil(math.log(max(wanted, 1e-9) / LEAST_WORDS, 1.2) - 1e-9))
    return round(LEAST_WORDS * 1.2 ** step)


class ProductCode:
    """One code: its rotation and words for a dimension, the same wherever they are made."""

    def __init__(self, dim: int, number: int = 0, *, codes: int = CODES, blocks: int = BLOCKS, words: int = 32, seed: int = SEED):
        rng = np.random.default_rng([seed, dim, number])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        bounds = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(bounds, bounds[1:])]
        self.code = []
        for part in self.parts:
            wide = int(part.stop - part.start)
            # a line has two directions and a plane few apart ones
            c = rng.standard_normal((min(words, 2 ** (2 * wide - 1)), wide))
            if wide == 1:
                c = np.array([[1.0], [-1.0]])
            # a direction is the concatenation of unit words over the root of their number
            self.code.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(len(self.parts)))
        self.size = int(np.prod([len(c) for c in self.code]))
        self.cut = self._fitted(rng, dim, PER_VECTOR / codes)

    def _fitted(self, rng, dim: int, wanted: float) -> float:
        """The cut at which random directions are in ``wanted`` filters on average.

        Inner products are about normal, with deviation one over the root of
        the dimension; the tail of sums of words is lighter, hence a search."""
        guess = NormalDist().inv_cdf(1 - min(0.5, wanted / self.size)) / np.sqrt(dim)
        probes = rng.standard_normal((int(np.clip((1 << 20) // self.size, 32, 512)), dim))
        probes /= np.linalg.norm(probes, axis=1, keepdims=True)
        low, high = 0.7 * guess, 1.1 * guess
        for _ in range(8):
            self.cut = (low + high) / 2
            if len(self.decode(probes)[0]) > wanted * len(probes):
                low = self.cut
            else:
                high = self.cut
        return min(high, 0.9)  # in few dimensions caps must not be narrower

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, filter)`` of every filter that a unit vector (a row) exceeds, and of its best one."""
        turned = unit @ self.turn
        scores = [turned[:, part] @ c.T for part, c in zip(self.parts, self.code)]
        best = [s.max(axis=1) for s in scores]
        owner = np.arange(len(unit))
        number = np.zeros(len(unit), dtype=np.int64)
        total = np.zeros(len(unit))
        # whoever reaches the cut nowhere is led to its best direction instead
        cut = np.minimum(self.cut, sum(best) - 1e-12)
        for k, s in enumerate(scores):
            later = sum((b for b in best[k + 1:]), np.zeros(len(unit)))
            grown, at_owner, at_number = [], [], []
            for i in range(0, len(owner), 1 << 14):
                o = owner[i:i + (1 << 14)]
                sums = total[i:i + (1 << 14), None] + s[o]
                r, w = np.nonzero(sums + later[o, None] >= cut[o, None])
                grown.append(sums[r, w])
                at_owner.append(o[r])
                at_number.append(number[i:i + (1 << 14)][r] * s.shape[1] + w)
            total, owner, number = np.concatenate(grown), np.concatenate(at_owner), np.concatenate(at_number)
        return owner, number


class FilterFamily:
    """Several codes with filters numbered through."""

    def __init__(self, dim: int, words: int, codes: int, blocks: int, seed: int):
        self.codes = [ProductCode(dim, k, codes=codes, blocks=blocks, words=words, seed=seed) for k in range(codes)]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each unit vector (a row)."""
        found = [c.decode(unit) for c in self.codes]
        owner = np.concatenate([o for o, _ in found])
        number = np.concatenate([n + k * c.size for k, (c, (_, n)) in enumerate(zip(self.codes, found))])
        order = np.lexsort((number, owner))
        return np.split(number[order], np.searchsorted(owner[order], np.arange(1, len(unit))))


_CODES: dict = {}


def _family(dim: int, words: int, options: tuple) -> FilterFamily:
    key = (dim, words, options)
    if key not in _CODES:
        if len(_CODES) >= 16:
            _CODES.clear()
        _CODES[key] = FilterFamily(dim, words, *options)
    return _CODES[key]


def _unit(v) -> np.ndarray | None:
    """The vector over its length in double precision; None where it links with nothing."""
    if v is None:
        return None
    a = np.array([np.nan if x is None else x for x in v], dtype=np.float64)
    if not a.size or not np.isfinite(a).all():
        return None
    top = np.abs(a).max()
    if top == 0:
        return None
    a = a / top  # neither overflow nor underflow of the squares
    return a / np.sqrt(a @ a)


def _words_column(size: Column, options: tuple) -> Column:
    """``words_for`` of a column."""
    wanted = F.pow(F.greatest(size, F.lit(1)) * float(PER_VECTOR) / (options[0] * PER_FILTER), F.lit(1 / options[1]))
    step = F.greatest(F.lit(0), F.ceil(F.log(wanted / LEAST_WORDS) / math.log(1.2) - 1e-9))
    return F.round(LEAST_WORDS * F.pow(F.lit(1.2), step)).cast("int")


def _members(rows: DataFrame, words: int | None, options: tuple) -> DataFrame:
    """``(row, label, dim, filters, vector)`` of the vectors that can link."""
    kind = rows.schema["vector"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            units = [_unit(v) for v in pdf["vector"]]
            by_dim: dict[tuple[int, int], list[int]] = {}
            for i, (u, w) in enumerate(zip(units, pdf["words"])):
                if u is not None:
                    by_dim.setdefault((len(u), int(w)), []).append(i)
            for (dim, words), at in by_dim.items():
                for k in range(0, len(at), 2048):
                    part = at[k:k + 2048]
                    table = np.stack([units[i] for i in part])
                    lists = _family(dim, words, options).decode(table)
                    yield pd.DataFrame({"row": pdf["row"].to_numpy()[part], "label": pdf["label"].to_numpy()[part], "dim": dim,
                                        "filters": [x.tolist() for x in lists], "vector": pdf["vector"].to_numpy()[part]})

    linkable = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull())
    if words is not None:
        linkable = linkable.withColumn("words", F.lit(words))
    else:  # labels beyond the least size; all others have the fewest words
        least = LEAST_WORDS ** options[1] * options[0] * PER_FILTER // PER_VECTOR
        sizes = staged(linkable.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > least), "label-sizes")
        few = sizes.count() <= BROADCAST_LABELS
        linkable = linkable.join(F.broadcast(sizes) if few else sizes, "label", "left").withColumn(
            "words", _words_column(F.coalesce("size", F.lit(0)), options)).select("row", "label", "vector", "words")
    return map_frames(linkable, run, f"row long, label string, dim int, filters array<int>, vector {kind}")


def _none_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row by row ``a`` and ``b`` (filter lists, padded by -1 and by -2) have nothing in common."""
    out = np.empty(len(a), dtype=bool)
    for i in range(0, len(a), 4096):
        out[i:i + 4096] = ~(a[i:i + 4096, :, None] == b[i:i + 4096, None, :]).any(axis=(1, 2))
    return out


def _any_shared(a, b, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For the pairs ``(i, j)`` of two lists of filter lists: whether they have something in common, by one
    product of incidence matrices (for many pairs of one block)."""
    known = np.unique(np.concatenate([np.concatenate([np.asarray(x, dtype=np.int32) for x in side]) if len(side) else
                                      np.empty(0, np.int32) for side in (a, b)]))
    made = []
    for side in (a, b):
        m = np.zeros((len(side), len(known)), dtype=np.float32)
        sizes = np.fromiter((len(x) for x in side), np.int64, len(side))
        if sizes.sum():
            m[np.repeat(np.arange(len(side)), sizes), np.searchsorted(known, np.concatenate([np.asarray(x) for x in side if len(x)]))] = 1
        made.append(m)
    return (made[0] @ made[1].T)[i, j] > 0


def _units(vectors) -> np.ndarray:
    """``_unit`` of vectors that are known to link, as rows of one table."""
    a = np.stack(list(vectors)).astype(np.float64)
    a /= np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt(np.einsum("ij,ij->i", a, a))[:, None]


def _lists(smaller, fill: int) -> np.ndarray:
    """The smaller filters of each vector, padded to one width."""
    out = np.full((len(smaller), max(map(len, smaller), default=0) or 1), fill, dtype=np.int32)
    for i, f in enumerate(smaller):
        out[i, :len(f)] = f
    return out


def _compare(a: pd.DataFrame, b: pd.DataFrame | None, threshold: float):
    """Links between two blocks of a filter (or within one) that share no smaller filter: row pairs."""
    ua = _units(a["vector"])
    ub = ua if b is None else _units(b["vector"])
    near = ua @ ub.T >= threshold - 1e-9
    if b is None:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if not len(i):
        return i, j
    exact = np.einsum("ij,ij->i", ua[i], ub[j]) >= threshold
    i, j = i[exact], j[exact]
    if len(i) > MANY_PAIRS:
        fresh = ~_any_shared(a["smaller"].tolist(), (a if b is None else b)["smaller"].tolist(), i, j)
        return i[fresh], j[fresh]
    la = _lists(a["smaller"], -1)
    lb = np.where(la < 0, -2, la) if b is None else _lists(b["smaller"], -2)
    fresh = _none_shared(la[i], lb[j])
    return i[fresh], j[fresh]


def _links(members: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """``(row, n, to)``: links counted at a row, and one edge of a spanning forest (null: none)."""
    # Filters are weighed by slim rows; the vectors move once, to the filters that others share.
    slim = members.select("row", "label", "dim", F.posexplode("filters").alias("k", "filter"))
    size = (slim.groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
            .withColumn("blocks", F.ceil(F.col("size") / block_rows).cast("int")).drop("size"))
    shared = (slim.join(size, ["label", "dim", "filter"]).groupBy("row")
              .agg(F.collect_list(F.struct("k", "filter", "blocks")).alias("shared")))  # at most the filters of one vector
    dealt = (members.join(shared, "row").select("*", F.inline("shared"))
             .withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", "dim", "filter", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                     "own", "row", F.slice("filters", F.lit(1), F.col("k")).alias("smaller"), "vector"))
    keys = ["label", "dim", "filter", "low", "high"]
    rows = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(frames):
        held: list[pd.DataFrame] = []
        held_key = None

        def flush(groups: pd.DataFrame):
            counts: dict[int, int] = {}
            edges_u, edges_v = [], []
            for (_, _, _, low, high), g in groups.groupby(keys, sort=False):
                if len(g) < 2:
                    continue
                if low == high:
                    a, b = g, None
                else:
                    a, b = g[g["own"] == low], g[g["own"] == high]
                    if not len(a) or not len(b):
                        continue
                i, j = _compare(a, b, threshold)
                if not len(i):
                    continue
                ra = a["row"].to_numpy()
                rb = ra if b is None else b["row"].to_numpy()
                u, v = ra[i], rb[j]
                ids, n = np.unique(np.concatenate((u, v)), return_counts=True)
                for r, k in zip(ids.tolist(), n.tolist()):
                    counts[r] = counts.get(r, 0) + k
                if len(u) > len(ids):
                    u, v = spanning(u, v)
                edges_u.append(u)
                edges_v.append(v)
            if counts:
                yield pd.DataFrame({"row": list(counts), "n": list(counts.values()), "to": pd.array([None] * len(counts), dtype="Int64")})
                yield pd.DataFrame({"row": np.concatenate(edges_u), "n": 0, "to": pd.array(np.concatenate(edges_v), dtype="Int64")})

        for pdf in frames:
            held.append(pdf)
            rows_here = pd.concat(held, ignore_index=True)
            last = rows_here[keys].iloc[-1]
            open_group = (rows_here[keys] == last).all(axis=1).to_numpy()
            done, rest = rows_here[~open_group], rows_here[open_group]
            held, held_key = [rest], tuple(last)
            if len(done):
                yield from flush(done)
        if held_key is not None:
            yield from flush(pd.concat(held, ignore_index=True))

    return map_frames(rows, run, "row long, n long, to long")


def near_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding",
                 label: str = "label", codes: int = CODES, blocks: int = BLOCKS, words: int | None = None, seed: int = SEED,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors``.

    Rows link when their labels are equal and not null and their cosine is at
    least ``threshold``; rows whose vector is null, empty, zero or holds a
    null or non-finite component link with nothing, rows of different lengths
    neither. ``component_id`` is the smallest ``vec_id`` reachable, the row's
    own included. Repeated rows are rows of their own and link; rows of a null
    ``vec_id`` count as partners but are never the smallest, and a component
    of null ids only has a null id and is kept. An empty table gives an empty
    one; further columns are not read. ``words`` fixes the size of the codes
    (default: by the size of the label).
    """
    kind = vectors.select(F.col(f"`{embedding}`")).schema[0].dataType.simpleString()
    if not kind.startswith("array"):
        raise ValueError(f"{embedding} must be an array, not {kind}")
    numbers = kind if kind == "array<float>" else "array<double>"  # floats are exact as doubles later
    rows = staged(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
                                 F.col(f"`{label}`").cast("string").alias("label"),
                                 F.col(f"`{embedding}`").cast(numbers).alias("vector")), "vectors")
    members = staged(_members(rows.select("row", "label", "vector"), words, (codes, blocks, seed)), "filters")
    found = staged(_links(members, threshold, block_rows), "links")
    counts = found.where("n > 0").groupBy("row").agg(F.sum("n").alias("n_links"))
    linked = components(found.where("to IS NOT NULL").select(F.col("row").alias("u"), F.col("to").alias("v")))
    marked = staged(rows.select("row", "vec_id").join(linked.select(F.col("node").alias("row"), "component"), "row", "left")
                    .join(counts, "row", "left")
                    .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                            F.coalesce("component", "row").alias("component")), "marked")
    least = marked.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return (marked.join(least, "component")
            .select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")))
