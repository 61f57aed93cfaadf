"""Embedding near duplicates by cross-polytope hashing.

Unit vectors are rotated by fast Hadamard transforms with random signs; a hash is the axis of the largest
coordinate and its sign. A table joins two such hashes to a bucket, and each vector also probes the next
best buckets. A pair is a candidate where one's own bucket is among the other's, and is verified by cosine
in double precision, in the first bucket the two share, so no pair is counted or emitted twice. Buckets
return link counts and stars, never pairs; hot buckets are dealt to cells of a grid. Equal vectors are one
node with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import components, grid_cells, stored
from termloom.llm.simhash import merge

TABLES = 12
PROBES = 4
HASHES = 2
SEED = 20
CELL_MOST = 4_096


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two wide), scaled to keep lengths."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def probes(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes_: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Buckets of unit vectors: (rows, tables, probes_) numbers, the own bucket first, tables told apart."""
    width = 1 << max(1, int(np.ceil(np.log2(max(2, x.shape[1])))))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables * hashes, 3, width))
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    out = np.empty((len(x), tables, probes_), np.int64)
    for t in range(tables):
        axes, loss = [], []
        for h in range(hashes):
            y = padded
            for s in signs[t * hashes + h]:
                y = hadamard(y * s)
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :probes_]
            best = np.take_along_axis(size, top, 1)
            axes.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
            loss.append((best[:, :1] - best) ** 2)
        pairs = [(i, j) for i in range(axes[0].shape[1]) for j in range(axes[-1].shape[1])] if hashes > 1 else [(i, i) for i in range(axes[0].shape[1])]
        i, j = np.array(pairs).T
        cost = loss[0][:, i] + (loss[1][:, j] if hashes > 1 else 0)
        bucket = axes[0][:, i] * (2 * width) + (axes[1][:, j] if hashes > 1 else 0)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes_]
        out[:, t] = t * (2 * width) ** 2 + np.take_along_axis(bucket, order, 1)
    return out


def usable(vector: str) -> Column:
    """Whether a vector is there, all its components are there and finite, and it is not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def verified(cell: list[pa.Table], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, their added link weights, and star edges (a, b) of one cell of one bucket."""
    t = cell
    node = t.column("node").to_numpy()
    x = _unit(t.column("v").combine_chunks())
    keys = t.column("keys").combine_chunks()
    weight = t.column("weight").to_numpy()
    tables = t.column("tables")[0].as_py()
    k = keys.flatten().to_numpy().astype(np.int64).reshape(len(node), tables, -1)
    bucket, i_, j_ = t.column("bucket")[0].as_py(), t.column("_i")[0].as_py(), t.column("_j")[0].as_py()
    chunk = t.column("_c").to_numpy()
    side_a, side_b = np.flatnonzero(chunk == i_), np.flatnonzero(chunk == j_)
    home = k[:, :, 0]
    table = bucket // t.column("span")[0].as_py()
    links = np.zeros(len(node), np.int64)
    label = np.arange(len(node))
    for lo in range(0, len(side_a), 512):
        a = side_a[lo : lo + 512]
        p, q = np.nonzero(x[a] @ x[side_b].T >= least)
        p, q = a[p], side_b[q]
        keep = (p < q) if i_ == j_ else np.ones(len(p), bool)
        p, q = p[keep], q[keep]
        for at in range(0, len(p), 200_000):
            u, w = p[at : at + 200_000], q[at : at + 200_000]
            fwd = (k[w] == home[u][:, :, None]).any(2)  # by table: u's own bucket is one of w's
            back = (k[u] == home[w][:, :, None]).any(2)
            both = fwd | back
            first = both.argmax(1)
            here_f, here_b = fwd[:, table] & (home[u, table] == bucket), back[:, table] & (home[w, table] == bucket)
            # of two meetings in one table the smaller bucket counts
            other = np.where(fwd[:, table] & back[:, table], np.minimum(home[u, table], home[w, table]), bucket)
            mine = (first == table) & (here_f | here_b) & (other == bucket)
            u, w = u[mine], w[mine]
            np.add.at(links, u, weight[w])
            np.add.at(links, w, weight[u])
            merge(label, u, w)
    some = np.flatnonzero(links)
    star = np.flatnonzero(label != np.arange(len(node)))
    return node[some], links[some], node[star], node[label[star]]


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, tables: int = TABLES, probes_: int = PROBES, most: int = CELL_MOST) -> DataFrame:
    """key, n_links (other rows linked directly), component_id (least key reachable) and kept (key = component_id) of every row.

    Rows are compared only when their labels are equal and not null and their vectors equally long.
    Vectors that are null, zero or hold null or non-finite components link with nothing and stand for
    themselves. Rows with equal label and vector are one node, so that copies cost one row. Rows of a
    repeated key are rows of their own: each counts the others. Null keys never name a component, unless
    all its keys are null; kept is then true. The index finds links of cosine `least` with a measured
    recall (README); it links no pair below.
    """
    src = stored(rows.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.col(label).alias("label"), (usable(vector) & F.col(label).isNotNull()).alias("ok")).withColumn("node", F.xxhash64("label", F.transform("v", lambda x: x + 0.0), F.size("v"))), "vectors")
    nodes = stored(src.where("ok").groupBy("node").agg(F.first("v").alias("v"), F.first("label").alias("label"), F.count(F.lit(1)).alias("weight"), F.min("key").alias("least")), "nodes")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            sizes = np.diff(v.offsets.to_numpy())
            for n in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == n))
                part = b.take(at)
                k = probes(_unit(part.column(1)), tables, HASHES, probes_)
                width = 1 << max(1, int(np.ceil(np.log2(max(2, n)))))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([(2 * width) ** 2] * len(at), pa.int64()), pa.array(k.reshape(len(at), -1).tolist(), pa.list_(pa.int32()))],
                    ["node", "v", "label", "weight", "span", "keys"])

    element = src.schema["v"].dataType.simpleString()
    held = nodes.select("node", "v", "label", "weight").mapInArrow(hashed, f"node long, v {element}, label {src.schema['label'].dataType.simpleString()}, weight long, span long, keys array<int>")
    held = stored(held, "hashed")
    x = held.select("label", F.size("v").alias("size"), "node", F.posexplode("keys").alias("pos", "bucket")).withColumn("home", F.col("pos") % probes_ == 0).drop("pos")
    x = grid_cells(x, ["label", "size", "bucket"], F.xxhash64("node"), most)
    # a pair needs two members, and the bucket has to be one's own
    cells = stored(x.groupBy("label", "size", "bucket", "_i", "_j").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("some")).where("n > 1 and some").drop("n", "some"), "cells")
    x = x.join(cells, ["label", "size", "bucket", "_i", "_j"]).join(held.select("node", "v", "weight", "span", "keys"), "node").withColumn("tables", F.lit(tables))
    x = x.withColumn("cell", F.xxhash64("label", "size", "bucket", "_i", "_j"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done: list[tuple]) -> Iterator[pa.RecordBatch]:
            node, links, a, b = (np.concatenate(c) for c in zip(*done, strict=True))
            none = pa.nulls(len(node), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), none, none], ["node", "links", "a", "b"])
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(a), pa.array(b)], ["node", "links", "a", "b"])

        left: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            ids = t.column("cell").to_numpy()
            cuts = np.flatnonzero(np.diff(ids)) + 1
            edges = [0, *cuts.tolist()]
            done = [verified(t.slice(s, e - s), least) for s, e in zip(edges, edges[1:], strict=False) if e - s > 1]
            left = t.slice(edges[-1])
            if done:
                yield from out(done)
        if left is not None and left.num_rows > 1:
            yield from out([verified(left, least)])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = x.select("cell", "bucket", "_i", "_j", "_c", "node", "v", "weight", "span", "keys", "tables").repartition(n, "cell").sortWithinPartitions("cell")
    found = stored(dealt.mapInArrow(check, "node long, links long, a long, b long"), "links")
    comp = components(found.where("a is not null").select("a", "b"))
    links = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "weight", "least").join(links, "node", "left").join(comp, "node", "left").select("node", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    named = stored(named, "named")
    least_key = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = stored(named.join(least_key, "component").select("node", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id"), "named")
    linked = src.where("ok").select("key", "node").join(named, "node").select("key", "n_links", "component_id")
    alone = src.where("not ok").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.union(alone).select(F.col("key").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
