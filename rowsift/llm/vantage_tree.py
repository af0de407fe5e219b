"""Centroid clustering (k-means on integer vectors) with a vantage-point tree.

Each round the driver builds a vantage-point tree over the few centroids and
sends it with the task: an inner node holds one centroid, its vantage point,
and two children, the nearer and the farther half of the others, each with the
smallest and largest distance of its members from the vantage point (a shell).
A leaf holds a few centroids. Every vector searches best first: of its open
nodes it takes the one of least lower bound, measures the centroids there by
exact integer distances, and opens the children with the bound that the
triangle inequality gives. It ends when the least bound exceeds the distance
of its best centroid; a bound equal to it is still followed, since a centroid
of smaller number may lie just there. All vectors of a batch take their steps
together, grouped by node, so a step is one small integer kernel per node.

Bounds are computed in doubles and lowered by more than their rounding error,
so no centroid at equal distance is ever cut off; what decides are integers.
Tasks hand on one sum per cluster, which Spark adds exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames, staged
from .int_vectors import finite, floor_means, floored, partial_frame, squared_distances, stacked, summed

LEAF = 4
#: Vectors that search together.
BATCH = 8192
#: Lowers a bound by more than the rounding of square roots and differences.
SLACK = 2.0 ** -48


def build_tree(centroids: np.ndarray, leaf: int = LEAF) -> list[dict]:
    """Nodes in order of creation, the root first; ``members`` are centroid numbers, ascending.

    The vantage point of a node is the member whose distances to the others
    vary most (ties: the smallest number)."""
    nodes: list[dict] = []

    def grow(members: list[int]) -> int:
        nodes.append({})
        me = len(nodes) - 1
        if len(members) <= leaf:
            nodes[me] = {"members": members, "children": []}
            return me
        points = centroids[members]
        apart = np.sqrt(squared_distances(points, points).astype(np.float64))
        vantage = int(apart.var(axis=1).argmax())
        others = [(float(d), m) for k, (d, m) in enumerate(zip(apart[vantage], members)) if k != vantage]
        others.sort()
        half = len(others) // 2
        children = []
        for side in (others[:half], others[half:]):
            if side:
                children.append((side[0][0], side[-1][0], grow(sorted(m for _, m in side))))
        nodes[me] = {"members": [members[vantage]], "children": children}
        return me

    if len(centroids):
        grow(list(range(len(centroids))))
    return nodes


def nearest(points: np.ndarray, centroids: np.ndarray, tree: list[dict], work: list | None = None):
    """Number and exact squared distance of each point's nearest centroid (ties: the smaller number).

    ``work``, when given, receives the number of distances measured."""
    n = len(points)
    best = np.full(n, np.iinfo(np.int64).max)
    who = np.full(n, len(centroids), np.int64)
    bound = np.full((n, len(tree)), np.inf)
    bound[:, 0] = 0.0
    active = np.arange(n)
    while len(active):
        at = bound[active].argmin(axis=1)
        low = bound[active, at]
        go = low <= np.sqrt(best[active].astype(np.float64)) * (1 + SLACK)  # inclusive radius
        go &= np.isfinite(low)
        active, at, low = active[go], at[go], low[go]
        for k in np.unique(at):
            rows, floor = active[at == k], low[at == k]
            bound[rows, k] = np.inf
            members = np.array(tree[k]["members"])
            d = squared_distances(points[rows], centroids[members])
            if work is not None:
                work.append(d.size)
            first = d.argmin(axis=1)  # members ascend: the smallest number among equals
            d1, m1 = d[np.arange(len(rows)), first], members[first]
            better = (d1 < best[rows]) | ((d1 == best[rows]) & (m1 < who[rows]))
            best[rows[better]], who[rows[better]] = d1[better], m1[better]
            if tree[k]["children"]:
                away = np.sqrt(d[:, 0].astype(np.float64))
                for lo, hi, child in tree[k]["children"]:
                    gap = np.maximum(away - hi, lo - away) - (away + hi) * SLACK
                    bound[rows, child] = np.maximum(floor, gap)
    return who, best


def _batches(frames, dims):
    for pdf in frames:
        for i in range(0, len(pdf), BATCH):
            part = pdf.iloc[i:i + BATCH]
            yield part, stacked(part["v"], dims)


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of rows ``vec_id, v``."""
    tree, dims = build_tree(centroids), centroids.shape[1]

    def run(frames):
        for part, points in _batches(frames, dims):
            who, d = nearest(points, centroids, tree)
            yield pd.DataFrame({"vec_id": part["vec_id"].array, "cluster": who.astype(np.int32), "distance": d})

    return map_frames(kept.select("vec_id", "v"), run, "vec_id long, cluster int, distance long")


def move(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floored mean of each cluster; an empty cluster keeps its centroid."""
    tree, (k, dims) = build_tree(centroids), centroids.shape

    def run(frames):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, points in _batches(frames, dims):
            who, _ = nearest(points, centroids, tree)
            order = np.argsort(who, kind="stable")
            used, starts = np.unique(who[order], return_index=True)
            if len(used):
                n += np.bincount(who, minlength=k)
                sums[used] += np.add.reduceat(points[order], starts, axis=0)
        yield partial_frame(["cluster"], [(c, int(n[c]), sums[c].tolist()) for c in np.flatnonzero(n)])

    out = centroids.copy()
    for (c,), (n, sums) in summed(kept.select("v"), run, "cluster int").items():
        out[c] = floor_means(n, sums)
    return out


def centroid_sha256(centroid) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, *, dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, salt: str = "2",
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per kept vector.

    Kept are vectors of exactly ``dims`` components, none null or not finite;
    others (null and empty ones too) have no row. Components become
    floor(scale * x). The first centroids are the ``k`` kept vectors of
    smallest SHA-256 of ``salt:vec_id`` (rows without id last, equal ids by
    their vectors); with fewer vectors there are fewer centroids. Repeated rows
    each give a row; a null id stays null; further columns are not read; an
    empty table gives an empty one. Only centroids, sums per cluster and the
    first ``k`` vectors reach the driver, whatever the number of rows.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("e"))
    kept = staged(rows.where((F.size("e") == dims) & finite("e")).select("vec_id", floored("e", scale, dims).alias("v")),
                  "integer-vectors")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(digest.asc_nulls_last(), F.col("vec_id").asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = stacked([r["v"] for r in first], dims)
    for _ in range(rounds if first else 0):
        centroids = move(kept, centroids)
    if not first:
        centroids = np.zeros((1, dims), np.int64)  # no row will meet it
    found = staged(assign(kept, centroids), "clusters")
    per = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    figures = kept.sparkSession.createDataFrame(
        [(c, d, sum(per.values()), centroid_sha256(centroids[c])) for c, d in sorted(per.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(figures), "cluster").select(  # a row per centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
