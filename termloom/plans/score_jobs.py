"""Scores over (posting, document) pairs that share a term."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom import dims
from termloom import fixed_values as fv
from termloom.functions import text as T
from termloom.operators import entries as E
from termloom.operators import lines as L
from termloom.operators import match as M
from termloom.operators import postings as P
from termloom.operators import scores as S
from termloom.operators import windows as W
from termloom.plans import corpus as D
from termloom.plans.match_jobs import pool, pool_evidence
from termloom.plans.posting_jobs import posting_lines, terms
from termloom.plans.registry import query
from termloom.plans.structure_jobs import segmented
from termloom.plans.text_jobs import _long

PAIR = ["posting_id", "doc_id"]
RANKED = 5  # documents a posting ranks


def flags(spark, sf):
    return D.stored(spark, sf, "flags", lambda: S.term_flags(pool(spark, sf), terms(spark, sf), D.PRIORITY_WEIGHTS))


def bullets(spark, sf):
    lines = D.document_lines(spark, sf)
    return lines.select("doc_id", F.lit("body").alias("section"), F.col("line_no").alias("bullet_no"), "text")


def present(spark, sf):
    return D.stored(spark, sf, "present", lambda: L.present_sections(L.sections(segmented(spark, sf))))


def order_scores(spark, sf):
    return L.canonical_order_score(present(spark, sf), dims.canonical_dim(spark))


def skills(spark, sf):
    return E.split_skills(segmented(spark, sf).filter("section_id = 'skills' and in_body"))


def features(spark, sf):
    build = lambda: S.doc_features(D.documents(spark, sf), bullets(spark, sf), present(spark, sf), order_scores(spark, sf), skills(spark, sf), D.VERBS)
    return D.stored(spark, sf, "features", build)


def roles(spark, sf):
    """Short lines stand in for held roles."""
    lines = D.document_lines(spark, sf)
    return lines.filter(F.length("text") <= 40).select("doc_id", F.col("text").alias("role"), "line_no")


def titles(spark, sf):
    return D.postings(spark, sf).select("posting_id", P.posting_title("text").alias("title"))


def duties(spark, sf):
    return D.stored(spark, sf, "duties", lambda: S.duty_words(posting_lines(spark, sf)))


def wide(spark, sf, marks=None, flagged=None, held=None, pairs=None):
    """The wide row of all pairs that share a term, or of ``pairs``; ``marks`` and ``flagged`` are evidence and flags with the columns that ``held`` sums."""
    f, d = flags(spark, sf) if flagged is None else flagged, duties(spark, sf)
    ev = pool_evidence(spark, sf) if marks is None else marks
    sums = S.pair_sums(f, ev, d, D.document_pieces(spark, sf), held, pairs)
    duty_total = d.groupBy("posting_id").agg(F.sum("n").alias("t_duty"))
    scored = D.stored(spark, sf, "doc_scores", lambda: S.with_doc_scores(features(spark, sf)))
    return S.wide_rows(sums, S.posting_totals(f), duty_total, titles(spark, sf), roles(spark, sf), scored, D.STOPS)


def ranked_pairs(spark, sf):
    """The documents each posting ranks: pairs for what is worked out only where someone looks at it."""
    return D.stored(spark, sf, "ranked_pairs", lambda: S.top_docs(flags(spark, sf), pool_evidence(spark, sf), RANKED).select(*PAIR))


def wide_of(spark, sf, pairs, evidence, docs, doc_features, support):
    """The wide feature row of given pairs; the tables may hold versions, keyed as documents. ``support``: evidence of what they were made from."""
    duties = S.duty_words(posting_lines(spark, sf))
    duty_total = duties.groupBy("posting_id").agg(F.sum("n").alias("t_duty"))
    t = S.title_alignment(pairs.select(*PAIR), titles(spark, sf), docs.select("doc_id", "source_id").join(roles(spark, sf).withColumnRenamed("doc_id", "source_id"), "source_id"), D.STOPS)
    hits = S.pair_hits(flags(spark, sf), evidence, pairs, support)
    return S.pair_features(hits, S.posting_totals(flags(spark, sf)), duty_total, S.duty_hits(duties, docs, pairs), t, doc_features)


def ats_overall(spark, sf):
    return S.overall_of(wide(spark, sf), S.ats_components(), fv.ATS_WEIGHTS, fv.ATS_BANDS, "weak")


def job_overall(spark, sf):
    return S.overall_of(wide(spark, sf), S.job_components(), fv.JOB_WEIGHTS, fv.JOB_BANDS, "low")


def term_sums(spark, sf, support=None):
    """Sums over evidenced terms beside the posting's totals: all that a component of terms reads, without titles and document features."""
    f = flags(spark, sf)
    return S.pair_hits(f, pool_evidence(spark, sf), support=support).join(S.posting_totals(f), "posting_id")


def duty_sums(spark, sf):
    """``term_sums`` with the duty words."""
    f, d = flags(spark, sf), duties(spark, sf)
    total = d.groupBy("posting_id").agg(F.sum("n").alias("t_duty"))
    sums = S.pair_sums(f, pool_evidence(spark, sf), d, D.document_pieces(spark, sf))
    return sums.join(S.posting_totals(f), "posting_id").join(total, "posting_id", "left").fillna(0, ["t_duty"])


def _component(rows, comps, name):
    return rows.select(*PAIR, comps[name].cast("int").cast("long").alias("value"))


def _doc_component(spark, sf, col):
    return features(spark, sf).select("doc_id", col.cast("long").alias("value"))


@query
def weighted_coverage(spark, sf):
    return S.weighted_coverage(flags(spark, sf), pool_evidence(spark, sf), "w_ats").select(*PAIR, _long("coverage"))


@query
def required_coverage(spark, sf):
    return _component(term_sums(spark, sf), S.ats_components(), "skillAlignment")


@query
def posting_language(spark, sf):
    return _component(duty_sums(spark, sf), S.ats_components(), "jdRelevance")


@query
def title_alignment(spark, sf):
    pairs = M.evidenced(pool(spark, sf).select("posting_id", "term"), pool_evidence(spark, sf).select("doc_id", "term")).select(*PAIR).distinct()
    return S.title_alignment(pairs, titles(spark, sf), roles(spark, sf), D.STOPS).select(*PAIR, _long("title_ats"), _long("title_job"))


@query
def verb_share(spark, sf):
    return _doc_component(spark, sf, S.verb_share())


@query
def readability(spark, sf):
    return _doc_component(spark, sf, S.readability())


@query
def section_order(spark, sf):
    return order_scores(spark, sf).select("doc_id", _long("order_score"))


@query
def structure_score(spark, sf):
    return _doc_component(spark, sf, S.structure_score())


@query
def overused_words(spark, sf):
    return S.overused_words(bullets(spark, sf)).select("doc_id", "section", "word", _long("n"), "severity")


@query
def duplicate_bullets(spark, sf):
    return S.duplicate_bullets(bullets(spark, sf)).select("doc_id", "bullet_key", _long("first_no"), _long("n_extra"))


@query
def duplicate_score(spark, sf):
    return _doc_component(spark, sf, S.duplicate_score())


@query
def missing_score(spark, sf):
    return _component(term_sums(spark, sf), S.ats_components(), "missingKeywords")


@query
def unsupported_score(spark, sf):
    """Mentions are held against the evidence of the source; a stored document is its own."""
    return _component(term_sums(spark, sf, support=pool_evidence(spark, sf)), S.ats_components(), "unsupportedKeywords")


@query
def evidence_strength(spark, sf):
    return _doc_component(spark, sf, S.evidence_strength())


@query
def ats_score(spark, sf):
    return ats_overall(spark, sf).select(*PAIR, _long("score"), "band")


@query
def job_match_score(spark, sf):
    s = job_overall(spark, sf)
    return s.select(*PAIR, _long("score"), "band", S.verdict(F.col("band")).alias("verdict"))


@query
def doc_metrics(spark, sf):
    m = S.doc_metrics(features(spark, sf))
    return m.select("doc_id", *[_long(c) for c in ("n_bullets", "n_skills", "n_sections", "mean_words", "n_metric", "n_words")])


@query
def corpus_rollup(spark, sf):
    s = job_overall(spark, sf)
    facts = s.join(D.documents(spark, sf).select("doc_id", "lang", "source"), "doc_id").join(
        D.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    r = S.corpus_rollup(facts, ["posting_id", "lang", "source", "quality"])
    return r.select("posting_id", "lang", "source", "quality", _long("level"), _long("n"), "mean_score", "median", "p90")


@query
def rank_docs(spark, sf):
    """Top five documents per posting by weighted term coverage."""
    return S.top_docs(flags(spark, sf), pool_evidence(spark, sf), RANKED).select("posting_id", _long("rank"), "doc_id", F.col("coverage").cast("long").alias("score"))


@query
def weakest_component(spark, sf):
    w = S.weakest_of(wide(spark, sf), S.ats_components(), fv.ATS_WEIGHTS)
    return w.select(*PAIR, "component", _long("value"))


@query
def top_gaps(spark, sf):
    p = pool(spark, sf)
    wanted = p.filter(F.col("priority").isin("HIGH", "MEDIUM")).select("posting_id", "priority", "term")
    miss = M.missing_lists(p, pool_evidence(spark, sf), wanted, ["priority", "term"])
    g = miss.select(*PAIR, F.posexplode(F.slice("missing", 1, 20)).alias("pos", "m"))
    return g.select(*PAIR, (F.col("pos") + 1).cast("long").alias("rank"), "m.term")


@query
def metric_first(spark, sf):
    b = bullets(spark, sf).withColumn("has_metric", T.has_metric("text"))
    return W.metric_first(b, ["doc_id"]).select("doc_id", _long("bullet_no"), _long("position"))


@query
def lookahead_header(spark, sf):
    lines = D.document_lines(spark, sf)
    h = W.lookahead_header(lines, T.any_word("text", ["from"]), ["doc_id"])
    return h.select("doc_id", _long("line_no"), "soon_date", "next_short")


@query
def first_seen_dedupe(spark, sf):
    t = D.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return E.first_seen(t, ["user_id", "event_type"], "event_id")


def customer_entries(spark, sf):
    d = D.dated_lines(spark, sf)
    y = T.date_years("dates")
    return d.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("entry_no"), F.get(y, F.lit(0)).alias("start_year"),
                    F.when(F.size(y) > 0, F.get(y, F.size(y) - 1)).alias("end_year"), T.is_current("dates").alias("is_current"),
                    F.concat(F.lit("Role "), "o_orderkey").alias("role"), F.lit("").alias("company"))


@query
def experience_span(spark, sf):
    return W.experience_span(customer_entries(spark, sf), 2024).select("doc_id", _long("span"), _long("years"))


@query
def current_role(spark, sf):
    return W.current_role(customer_entries(spark, sf))


@query
def keep_last_12(spark, sf):
    r = D.table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), "ts", F.col("event_id").alias("version_id"))
    return W.keep_last(r, fv.VERSIONS_KEPT).select("doc_id", "version_id", _long("age"), "is_current")
