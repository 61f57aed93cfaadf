"""Revision streams: activity windows, kept versions and re-scoring.

Each micro-batch is handed to the batch job and its result is appended as a
delta in the shared folder under the batch id, so a replayed batch overwrites
itself.  Readers fold the deltas: the newest twelve of the newest twelve of
every batch are the newest twelve overall.  No key has to fit one task, since the
batch jobs limit and aggregate before they shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import fixed_values as fv
from termloom.operators.windows import keep_last, top_k
from termloom.session import checkpoint_dir, write_once

REVISION_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_revisions(spark: SparkSession, folder: str, glob: str = "*.parquet", schema: str = REVISION_SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    """A folder of revision files as a stream; one revision = one edit of document ``doc_id``."""
    s = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return s.select(F.col("user_id").alias("doc_id"), "ts", F.col("event_id").alias("version_id"), "event_type",
                    F.from_json("props", "k int")["k"].alias("k"))


def read_table_revisions(spark: SparkSession, folder: str, table: str, schema: str = REVISION_SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    """A stored table as a stream, be it one file or a folder of part files: a pattern names either."""
    return read_revisions(spark, f"{folder}/{table}.parque[t]", "*.parquet", schema, files_per_batch)


def unique_revisions(revisions: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Redelivered revisions out; the watermark bounds the remembered ids."""
    return revisions.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["version_id"])


def activity(revisions: DataFrame, lateness: str = "1 hour", every: str = "1 day", slide: str | None = None, gap: str | None = None) -> DataFrame:
    """Edits per document in tumbling, sliding or session windows; late rows fall to the watermark."""
    win = F.session_window("ts", gap) if gap else F.window("ts", every, slide or every)
    g = revisions.withWatermark("ts", lateness).groupBy(win.alias("w"), "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_deltas(stream: DataFrame, job: Callable[[DataFrame], DataFrame], name: str, mode: str = "append", root: str | None = None) -> str:
    """Run the stream over what is available; returns the folder of the deltas."""
    spark = stream.sparkSession
    root = root or f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def handle(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{root}/delta/batch_id={batch_id}")

    q = (
        stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", f"{root}/offsets")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return f"{root}/delta"


def latest(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Newest delta per key; ``max_by`` combines map-side."""
    cols = [c for c in deltas.columns if c not in (*keys, "batch_id")]
    best = deltas.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols])


def stream_versions(revisions: DataFrame, k: int = fv.VERSIONS_KEPT, root: str | None = None) -> DataFrame:
    """Newest k versions per document after the stream has been read; a given root is resumed where it stopped."""
    pick = lambda df: top_k(df.select("doc_id", "ts", "version_id"), ["doc_id"], [F.desc("ts"), F.desc("version_id")], k).drop("rank")
    path = run_deltas(unique_revisions(revisions), pick, "versions", root=root)
    return keep_last(revisions.sparkSession.read.parquet(path).drop("batch_id"), k)


def stream_activity(revisions: DataFrame, **window: str) -> DataFrame:
    """Counts per document and window; update mode re-emits a window, the newest emission counts."""
    path = run_deltas(activity(revisions, **window), lambda df: df, "activity", "update" if "gap" not in window else "append")
    return latest(revisions.sparkSession.read.parquet(path), ["doc_id", "start", "end"])


def stream_sessions(revisions: DataFrame, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Sessions of edits per document that the watermark has closed, each once; a session that may still grow is not in it.

    A revision counts nowhere if its session ended before the watermark of the last batch, which lies ``lateness`` behind
    the newest revision of the batches before that one.
    """
    path = run_deltas(activity(revisions, lateness, gap=gap), lambda df: df, "sessions")
    return revisions.sparkSession.read.parquet(path).drop("batch_id")


# ------------------------------------------------------------------- rescoring
NEWEST = ["ts", "version_id"]


def newest_revisions(revisions: DataFrame) -> DataFrame:
    """All columns of the newest revision per document; ``max_by`` combines before the shuffle."""
    rest = [c for c in revisions.columns if c != "doc_id"]
    return revisions.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct(*NEWEST)).alias("r")).select("doc_id", "r.*")


def scored_batch(batch: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of the newest revision of each document of a batch, named by its version; a document without any keeps one row of nulls."""
    fresh = write_once(newest_revisions(batch), "fresh")
    return fresh.select("doc_id", *NEWEST).join(score(fresh), "doc_id", "left")


def fold_scores(deltas: DataFrame) -> DataFrame:
    """Rows of the newest version per document, whatever batches brought it, and however often.

    Rows of nulls stay, so a later fold still knows that an older version of the document is no longer the newest.
    """
    head = deltas.groupBy("doc_id").agg(F.max(F.struct(*NEWEST)).alias("_v")).select("doc_id", "_v.*")
    return deltas.join(head, ["doc_id", *NEWEST]).dropDuplicates(["doc_id", "posting_id"])


def _state(spark: SparkSession, root: str) -> tuple[int, DataFrame]:
    """Batch id up to which deltas are folded into the base, and all rows that count: the base and the deltas behind it."""
    upto = spark.read.schema("upto long").parquet(f"{root}/done").agg(F.max("upto")).first()[0]
    deltas = spark.read.parquet(f"{root}/delta").filter(F.col("batch_id") > upto).drop("batch_id")
    return upto, deltas if upto < 0 else spark.read.parquet(f"{root}/base/at={upto}").unionByName(deltas)


def compact(spark: SparkSession, root: str) -> int:
    """Fold the base and all deltas into a new base; returns the last batch id in it.

    The base is written beside the old one and counts once its mark is written, so a job that dies between leaves the
    old state.  Run it between runs of the stream; folding twice gives the same rows.
    """
    upto, rows = _state(spark, root)
    last = spark.read.parquet(f"{root}/delta").agg(F.max("batch_id")).first()[0]
    if last is not None and last > upto:
        fold_scores(rows).write.mode("overwrite").parquet(f"{root}/base/at={last}")
        _mark(spark, root, last)
        upto = last
    return upto


def _mark(spark: SparkSession, root: str, upto: int) -> None:
    spark.range(1).select(F.lit(upto).cast("long").alias("upto")).write.mode("append").parquet(f"{root}/done")


def rescored(spark: SparkSession, root: str) -> DataFrame:
    """Scores of the newest text of every revised document, from the base and the deltas behind it."""
    return fold_scores(_state(spark, root)[1]).filter("posting_id is not null").drop(*NEWEST)


def stream_rescore(revisions: DataFrame, score: Callable[[DataFrame], DataFrame], root: str | None = None) -> DataFrame:
    """Scores of revised documents (doc_id, ts, version_id and what ``score`` reads) by their newest revision.

    Posting terms stay as analysed, only the documents of a batch are matched again, by the batch job ``score``: it takes
    the newest revisions, with their text or what makes it, and returns posting_id, doc_id and scores.  Newest goes by time, then version, not by arrival: late and redelivered revisions and replayed batches change nothing, so
    the stream keeps no state.  A given root is resumed where it stopped.
    """
    spark = revisions.sparkSession
    root = root or f"{checkpoint_dir(spark)}/rescore-{uuid.uuid4().hex}"
    _mark(spark, root, -1)
    run_deltas(revisions, lambda batch: scored_batch(batch, score), "rescore", root=root)
    return rescored(spark, root)
