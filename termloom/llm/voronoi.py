"""Exact top-k inner products by a Voronoi join.

Pivots split queries and data into cells. Summaries of the data cells (radius, the k smallest distances to
the pivot) bound what a cell can offer: q.x <= q.p + |q| r and q.x >= q.p - |q| d. From them each group of
queries gets a floor for its k-th score, and a row of data is replicated to a group only if its own bound
q.x <= max(q.p) + max|q| d reaches that floor. Groups are then solved locally, in blocks, and the blocks'
top-k lists are merged. Equal vectors are one row with the k + 1 least ids, as no other of them can be in
any top k, so a vector that a third of all rows share costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm.common import stored

PIVOTS = 64
GROUP_QUERIES = 1024
CHUNK_ROWS = 16_384
SUMMARY_STEPS = 64  # of a distance, per factor of e


def quantised(vector: str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, in doubles; null unless all components are there and finite."""
    good = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _assigned(rows: DataFrame, pivots: np.ndarray, keep: str) -> DataFrame:
    """Add cell (nearest pivot) and dist (to it); the pivots are a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"))
            d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1), 0))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])], [*b.schema.names, "cell", "dist"])

    return rows.mapInArrow(run, f"{keep}, cell int, dist double")


def top_k(rows: DataFrame, key: str, vector: str, k: int = 10, query: Column | None = None, pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k largest inner products with other rows.

    rows[vector] is an array of whole numbers (see quantised); rows whose vector or key is null take no
    part, and so do rows of another length than most pivots have. Ties go to the smaller id; fewer than k
    candidates are all returned. A query leaves out rows with its own id; repeated rows of a key count
    once per vector. Scores are exact while sums stay below 2 ** 53. Bounds have a slack against rounding,
    so they only ever replicate more.
    """
    query = (F.col(key) % 100 == 0) if query is None else query
    src = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), query.alias("asked"))
    src = stored(src, "vectors")
    by_id = Window.partitionBy("v").orderBy("id")
    least = src.select("v", "id").distinct().withColumn("no", F.row_number().over(by_id)).where(F.col("no") <= k + 1)
    same = stored(least.groupBy("v").agg(F.collect_list("id").alias("ids")), "same")
    first = same.select("v").orderBy(F.xxhash64("v")).limit(pivots).toArrow().column("v").to_pylist()
    if not first:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max({len(v) for v in first}, key=[len(v) for v in first].count)
    points = np.array([v for v in first if len(v) == width], np.float64)
    data = stored(_assigned(same.where(F.size("v") == width), points, "v array<bigint>, ids array<bigint>"), "cells")
    queries = stored(_assigned(src.where("asked").where(F.size("v") == width).select("v", "id").distinct(), points, "v array<bigint>, id bigint"), "queries")

    cells = data.groupBy("cell").agg(F.max("dist").alias("radius"))
    step = F.when(F.col("dist") > 0, F.ceil(F.log("dist") * SUMMARY_STEPS)).alias("step")
    steps = data.groupBy("cell", step).agg(F.sum(F.size("ids")).alias("n"))
    summary = sorted(cells.collect())  # a row per pivot
    near = sorted((r["cell"], 0.0 if r["step"] is None else float(np.exp((r["step"] + 1e-6) / SUMMARY_STEPS)), r["n"]) for r in steps.collect())  # at most the steps of a double per pivot
    at = np.array([r["cell"] for r in summary], np.int64)
    place = {int(c): i for i, c in enumerate(at)}
    radius = np.array([r["radius"] for r in summary])
    close, close_cell, have = [], [], dict.fromkeys(place, 0)
    for cell, upper, n in near:  # upper bounds of the k + 1 least distances
        for _ in range(min(n, k + 1 - have[cell])):
            close.append(upper)
            close_cell.append(place[cell])
            have[cell] += 1
    close, close_cell = np.array(close), np.array(close_cell, np.int64)
    held = points[at]

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("v"))
            norm = np.sqrt((q**2).sum(1))
            dot = q @ held.T
            least = dot[:, close_cell] - norm[:, None] * close
            # the query's own row may be one of those counted, so the k + 1 st bound holds for k others
            floor = -np.partition(-least, k, axis=1)[:, k] if least.shape[1] > k else np.full(len(q), -np.inf)
            # what one row at distance d of pivot p can reach: q.p + |q| d; a cell is needed if its radius can
            need = dot + norm[:, None] * radius >= (floor - 1e-6 * (1 + np.abs(floor)))[:, None]
            row, cell = np.nonzero(need)
            # per needed cell the least distance at which a row can still count
            reach = np.where(norm[row] > 0, (floor[row] - dot[row, cell]) / np.maximum(norm[row], 1e-300), -np.inf)
            ids = b.column("id").to_numpy()
            home = b.column("cell").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), b.column("v").take(pa.array(row)), pa.array(home[row]), pa.array(at[cell].astype(np.int32)), pa.array(reach - 1e-6 * (1 + np.abs(reach)))], ["id", "v", "home", "cell", "reach"])

    wide = queries.mapInArrow(limits, "id long, v array<bigint>, home int, cell int, reach double")
    # queries of one home cell in blocks: a group
    count = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / group_queries).cast("int").alias("parts")).withColumnRenamed("cell", "home")
    asked = stored(wide.join(count, "home").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts"), "asked")
    groups = asked.groupBy("cell", "home", "block").agg(F.min("reach").alias("reach"))

    # data of one cell in chunks; a chunk meets a group of queries if one of its rows can count there
    chunks = data.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("parts"))
    split = data.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    unit = F.xxhash64("cell", "home", "block", "chunk").alias("unit")
    sent = split.join(stored(groups, "groups"), "cell").where("dist >= reach").select(unit, F.lit(None).cast("long").alias("id"), "v", "ids")
    meets = asked.join(chunks, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(unit, "id", "v", F.lit(None).cast("array<bigint>").alias("ids"))

    def solve(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
        a, b = np.stack(x["v"].to_numpy()).astype(np.float64), np.stack(y["v"].to_numpy()).astype(np.float64)
        own, ids = x["id"].to_numpy(), y["ids"].to_numpy()
        out_q, out_v, out_s = [], [], []
        for lo in range(0, len(a), 256):
            scores = a[lo : lo + 256] @ b.T
            for i, s in enumerate(scores):
                me = own[lo + i]
                if len(s) > k + 1:  # all vectors at or above the k + 1 st score: one of them may be the query's own
                    pick = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1])
                else:
                    pick = np.arange(len(s))
                best: dict[int, int] = {}
                for j in pick:
                    for v in ids[j]:
                        if v != me:
                            best[v] = max(best.get(v, int(s[j])), int(s[j]))
                found = sorted((-n, v) for v, n in best.items())[:k]
                out_q += [me] * len(found)
                out_v += [v for _, v in found]
                out_s += [-n for n, _ in found]
        return pd.DataFrame({"query_id": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_s, np.int64)})

    local = meets.select("unit", "id", "v").groupBy("unit").cogroup(sent.select("unit", "v", "ids").groupBy("unit")).applyInPandas(solve, "query_id long, vec_id long, score long")
    # a key with several vectors may be met more than once: its best score counts
    best = local.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
