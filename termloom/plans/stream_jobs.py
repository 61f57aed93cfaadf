"""Stream jobs over the stored events: user = document, event = revision."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.operators import scores as S
from termloom.plans import corpus as D
from termloom.plans.match_jobs import evidence_of, pool
from termloom.plans.registry import query
from termloom.plans.score_jobs import flags
from termloom.plans.text_jobs import _long
from termloom.session import write_once
from termloom.streaming import streams as ST


def revisions(spark, sf):
    return ST.read_table_revisions(spark, sf, "events")


@query
def stream_versions(spark, sf):
    return ST.stream_versions(revisions(spark, sf)).select("doc_id", "version_id", _long("age"), "is_current")


@query
def stream_activity(spark, sf):
    a = ST.stream_activity(revisions(spark, sf), every="1 day")
    return a.select("doc_id", F.date_format("start", "yyyy-MM-dd").alias("day"), _long("n"))


@query
def activity_sliding(spark, sf):
    """Edits per document in days that start every six hours."""
    a = ST.stream_activity(revisions(spark, sf), every="1 day", slide="6 hours")
    return a.select("doc_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), _long("n"))


@query
def activity_sessions(spark, sf):
    """Closed sessions of edits that follow each other within six hours."""
    a = ST.stream_sessions(revisions(spark, sf), "6 hours")
    return a.select("doc_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), _long("n"))


def revised_texts(spark, sf, newest):
    """(doc_id, text) of revisions: an edit appends to the stored document the text of the one that its number k names."""
    docs = D.documents(spark, sf)
    own, more = docs.select("doc_id", F.col("text").alias("_own")), docs.select(F.col("doc_id").alias("k"), F.col("text").alias("_more"))
    edits = newest.select("doc_id", F.col("k").cast("long").alias("k"))
    return edits.join(own, "doc_id").join(more, "k", "left").select("doc_id", F.concat_ws("\n", "_own", "_more").alias("text"))


@query
def stream_rescore(spark, sf):
    """Weighted coverage of the newest revised text: the evidence of the batch jobs, synonyms and any-order rule included."""
    wanted, terms = flags(spark, sf), pool(spark, sf)

    def score(newest):
        texts = write_once(revised_texts(spark, sf, newest), "revised")
        return S.weighted_coverage(wanted, evidence_of(spark, sf, terms, texts))

    return ST.stream_rescore(revisions(spark, sf), score).select("posting_id", "doc_id", _long("coverage"))
