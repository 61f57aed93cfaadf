"""Helpers the operators share: stored tables, grid cells for hot keys, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Unset, a local master gets a folder of its own (tests); elsewhere that would lose rows, so it raises.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, n: int, column: str) -> DataFrame:
    """Like stored, but bucketed: a later grouping or join by the column needs no shuffle of this side."""
    spark = df.sparkSession
    at = f"llm_{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{at}").bucketBy(n, column).format("parquet").saveAsTable(at)
    return spark.read.table(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds few texts as Python strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def give_back() -> None:
    """Return freed memory of a reused Python worker to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def grid_cells(df: DataFrame, keys: list[str], member: Column, most: int) -> DataFrame:
    """Deal the members of each key to cells of a triangular grid, so that no task holds a whole hot key.

    A key with n members has m = ceil(n / most) chunks; each pair of chunks i <= j is one cell. A member
    of chunk c goes to the cells that touch c, so every two members meet in at least one cell, and in
    exactly one when their chunks differ. Adds _i, _j (the cell) and _c (the member's chunk). m is 1 for
    all but hot keys, where it costs m copies of each member instead of one unbounded group.
    """
    sizes = stored(df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_m")).where("_m > 1"), "hot")
    x = df.join(sizes, keys, "left").withColumn("_m", F.coalesce("_m", F.lit(1)))
    x = x.withColumn("_c", F.pmod(member, F.col("_m")).cast("int"))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return x.withColumns({"_i": F.least("_c", "_o"), "_j": F.greatest("_c", "_o")}).drop("_m", "_o")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list by alternating large-star and small-star rounds.

    Returns (node, component), component being the smallest node reachable; nodes without an edge to
    another node are absent. Each round is a partial minimum per node and a plain join against the stored
    minima, which adaptive execution can split when one node has most edges. Raises rather than returning
    unfinished labels.
    """
    e = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = mark(e)  # stars are done after one round
    for _ in range(most_rounds if seen[0] else 0):
        sym = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        e = stored(sym.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stored(e.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = e.join(least, "u")
        pairs = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v")
        e = stored(pairs.where("u != v").distinct(), "small")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
