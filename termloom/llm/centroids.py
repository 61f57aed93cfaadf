"""Centroid clustering over whole numbers, with a vantage-point tree over the centroids.

Each round builds a tree over the k centroids on the driver and sends it with the task; every vector is
assigned by best-first branch and bound, and the rows of a task leave it as one partial sum per centroid,
whatever the number of vectors. Distances are exact whole numbers. Bounds are square roots, so a branch is
only left when its bound is above the best distance by more than the rounding can explain: equal distances
are always visited, and the smaller number wins.

What reaches the driver: k starting vectors, and k * d sums a round.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import stored

PLAIN = 1 << 26  # components up to here: sums of squares of up to 512 differences fit a long
LIMB = 60  # bits of a part of a partial sum
LONG = (1 << 63) - 1
SLACK = 1e-9


class Node(NamedTuple):
    """A centroid as vantage point, and its children as (number of the node, least and greatest distance to it)."""

    point: int
    children: tuple[tuple[int, float, float], ...]


class Tree(NamedTuple):
    points: list[list[int]]
    nodes: list[Node]  # the root first; empty without centroids


def whole(x: float) -> int:
    """floor(1024 * x), exact for every finite x."""
    return math.floor(x * 1024) if abs(x) < 2.0**52 else int(x) * 1024


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def root(d: int) -> float:
    """Square root of a whole number of any size (infinite beyond the doubles)."""
    if d < 1 << 1000:
        return math.sqrt(d)
    r = math.isqrt(d)
    return float(r) if r < 1 << 1023 else math.inf


def build(points: list[list[int]]) -> Tree:
    """The tree: the first point of a set is its vantage point, the others part at their median distance to it."""
    nodes: list[Node] = []

    def grow(those: list[int]) -> int:
        at = len(nodes)
        nodes.append(Node(those[0], ()))
        far = sorted((squared(points[those[0]], points[i]), i) for i in those[1:])
        half = (len(far) + 1) // 2
        children = []
        for part in (far[:half], far[half:]):
            if part:
                children.append((grow(sorted(i for _, i in part)), root(part[0][0]), root(part[-1][0])))
        nodes[at] = Node(those[0], tuple(children))
        return at

    if points:
        grow(list(range(len(points))))
    return Tree(points, nodes)


def nearest_one(tree: Tree, v: list[int]) -> tuple[int, int]:
    """(centroid, squared distance) of one vector of any size of components, by a best-first search."""
    best, found = None, [(0.0, 0)]
    while found:
        bound, at = heapq.heappop(found)
        if best is not None and bound > root(best[0]) * (1 + SLACK):
            break
        node = tree.nodes[at]
        d = squared(tree.points[node.point], v)
        best = (d, node.point) if best is None else min(best, (d, node.point))
        r = root(d)
        for child, low, high in node.children:
            gap = max(low - r, r - high) if math.isfinite(r) and math.isfinite(high) else 0.0
            heapq.heappush(found, (max(bound, gap - SLACK * (r + high)) if math.isfinite(gap) and math.isfinite(r + high) else bound, child))
    return best[1], best[0]


def nearest(tree: Tree, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of every row, all searches side by side: each takes its own best open node in every step."""
    n = len(v)
    points = np.array(tree.points, np.int64)
    bound = np.full((n, len(tree.nodes)), np.inf)
    bound[:, 0] = 0.0
    least, which = np.full(n, LONG), np.full(n, len(points))
    live = np.arange(n)
    while len(live):
        open_ = bound[live]
        at = open_.argmin(1)
        go = open_[np.arange(len(live)), at] <= np.sqrt(least[live].astype(float)) * (1 + SLACK)
        go &= np.isfinite(open_[np.arange(len(live)), at])
        live, at = live[go], at[go]
        for k in np.unique(at):
            node, rows = tree.nodes[k], live[at == k]
            gap = v[rows] - points[node.point]
            d = np.einsum("ij,ij->i", gap, gap)
            better = (d < least[rows]) | ((d == least[rows]) & (node.point < which[rows]))
            least[rows[better]], which[rows[better]] = d[better], node.point
            r, held = np.sqrt(d.astype(float)), bound[rows, k]
            for child, low, high in node.children:
                bound[rows, child] = np.maximum(held, np.maximum(low - r, r - high) - SLACK * (r + high))
            bound[rows, k] = np.inf
    return which, least


def kept(vector: Column, dims: int) -> Column:
    """Whether a vector takes part: dims components, none null or not finite."""
    x = vector.cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(x) == dims) & good, F.lit(False))


def _plain(points: list[list[int]]) -> bool:
    return all(abs(x) <= PLAIN for p in points for x in p) and all(len(p) <= 512 for p in points)


def _assigned(b: pa.RecordBatch, dims: int, tree: Tree) -> Iterator[tuple[np.ndarray, np.ndarray | list[list[int]], np.ndarray, list[int]]]:
    """(rows, vectors, centroids, distances): the rows of plain size together, then the others one by one."""
    x = np.asarray(b.column("v").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(b.num_rows, dims)
    small = (np.abs(x) * 1024 < PLAIN).all(1) & _plain(tree.points)
    rows = np.flatnonzero(small)
    if len(rows):
        v = np.floor(x[rows] * 1024).astype(np.int64)
        which, least = nearest(tree, v)
        yield rows, v, which, least.tolist()
    for i in np.flatnonzero(~small):
        v = [whole(c) for c in x[i].tolist()]
        c, d = nearest_one(tree, v)
        yield np.array([i]), [v], np.array([c]), [d]


def limbs(n: int) -> list[int]:
    """The whole number as base 2 ** LIMB digits, least first, the sign on each."""
    sign, n, out = (-1, -n, []) if n < 0 else (1, n, [])
    while n:
        out.append(sign * (n & ((1 << LIMB) - 1)))
        n >>= LIMB
    return out or [0]


def sums(vectors: DataFrame, dims: int, tree: Tree) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sum of the vectors of every centroid that has some."""
    k = len(tree.points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [[0] * dims for _ in range(k)], [0] * k
        for b in batches:
            for _, v, which, _ in _assigned(b, dims, tree):
                for c in np.unique(which).tolist():
                    mine = which == c
                    part = v[mine].sum(0).tolist() if isinstance(v, np.ndarray) else v[0]
                    total[c] = [a + x for a, x in zip(total[c], part, strict=True)]
                    n[c] += int(mine.sum())
        rows = [(c, i, j, d) for c in range(k) if n[c] for i, x in enumerate([*total[c], n[c]]) for j, d in enumerate(limbs(x))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["c", "i", "limb", "part"])

    parts = vectors.select("v").mapInArrow(run, "c int, i int, limb int, part long")
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("c", "i", "limb").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("s")).collect():
        out.setdefault(r.c, [0] * (dims + 1))[r.i] += int(r.s) << (LIMB * r.limb)
    return {c: (s[dims], s[:dims]) for c, s in out.items()}


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """Cluster of every vector that takes part, after `rounds` rounds of assignment and replacement.

    Returns key, cluster int, distance long (squared), cluster_inertia and inertia long, centroid_sha256.
    Starting centroids are the k vectors with the smallest sha256 of "<seed>:<key>"; of rows that repeat a key the smaller
    vector comes first, null keys come last. Fewer than k vectors give as many centroids, none gives no row. Vectors
    that are null, of another length or with null or non-finite components take no part. Repeated rows count each. A
    distance or sum beyond a long is null. Other columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    src = rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(kept(F.col("v"), dims))
    vectors = stored(src, "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = vectors.select(name.alias("h"), F.col("v").cast("array<double>").alias("v")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    points = [[whole(x) for x in r.v] for r in first]
    for _ in range(rounds if points else 0):
        new = list(points)
        for c, (n, total) in sums(vectors, dims, build(points)).items():
            new[c] = [x // n for x in total]
        if new == points:  # all later rounds would repeat this one
            break
        points = new
    tree = build(points)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, far = np.zeros(b.num_rows, np.int32), [None] * b.num_rows
            for at, _, c, d in _assigned(b, dims, tree):
                which[at] = c
                for i, x in zip(at.tolist(), d, strict=True):
                    far[i] = x if x <= LONG else None
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(which, pa.int32()), pa.array(far, pa.int64())], ["key", "cluster", "distance"])

    kind = vectors.schema["key"].dataType.simpleString()
    labelled = stored(vectors.mapInArrow(label, f"key {kind}, cluster int, distance long"), "labelled")
    inertia = {r.cluster: r.s for r in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    fits = [None if s is None or s > LONG else int(s) for s in (*(inertia.get(c) for c in range(len(points))), sum(s or 0 for s in inertia.values()))]
    said = [(c, fits[c], fits[-1], hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(points)]
    per = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labelled.join(per, "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
