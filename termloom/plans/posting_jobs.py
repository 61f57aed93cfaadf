"""Posting analysis over the stored short texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import postings as P
from termloom.operators.windows import sticky_mode as carry
from termloom.plans import corpus as D
from termloom.plans.registry import query
from termloom.plans.text_jobs import _long, _vocabulary

CFG = P.PostingConfig(
    stop_words=tuple(D.STOPS), banned=tuple(D.BANNED), filler=tuple(D.FILLER), ad_words=tuple(D.AD_WORDS), cues=D.CUES,
    synonyms=D.SYNONYMS, credentials=D.CREDENTIALS, soft_skills=tuple(D.SOFT), tech=tuple(D.TECH),
    qualification=tuple(D.QUAL), domain=tuple(D.DOMAIN), soft_words=tuple(D.SOFT_WORDS))


def posting_lines(spark, sf):
    return P.bucket_lines(D.postings(spark, sf), D.CUES)


def terms(spark, sf):
    return D.stored(spark, sf, "posting_terms", lambda: P.posting_terms(D.postings(spark, sf), CFG))


@query
def bucket_lines(spark, sf):
    return posting_lines(spark, sf).select("posting_id", _long("line_no"), "text", "bucket")


@query
def sticky_mode(spark, sf):
    lines = D.document_lines(spark, sf)
    cue = F.when(T.any_word("text", ["with"]), "a").when(T.any_word("text", ["from", "que"]), "b")
    return carry(lines, "doc_id", "line_no", cue).select("doc_id", _long("line_no"), "mode")


@query
def bucket_counts(spark, sf):
    return P.bucket_counts(posting_lines(spark, sf)).select("posting_id", "bucket", _long("n"))


@query
def posting_excerpts(spark, sf):
    x = P.posting_excerpts(posting_lines(spark, sf), {"qualifications": 12, "responsibilities": 24, "general": 2})
    return x.select("posting_id", "bucket", _long("rank"), "text")


@query
def posting_title(spark, sf):
    return D.postings(spark, sf).select("posting_id", P.posting_title("text").alias("title"))


@query
def ngrams(spark, sf):
    g = P.ngrams(D.documents(spark, sf), "doc_id", "text", D.STOPS, D.BANNED, 3, 40)
    return g.select("doc_id", "term", _long("cnt"), _long("rank"))


@query
def line_candidates(spark, sf):
    c = P.line_candidates(posting_lines(spark, sf), CFG)
    return c.select("posting_id", _long("line_no"), _long("part_no"), "term", _long("cnt"))


@query
def trim_filler(spark, sf):
    v = D.document_lines(spark, sf).select(F.lower("text").alias("term")).distinct()
    return v.select("term", P.trim_filler("term", D.FILLER).alias("core"))


@query
def noise_terms(spark, sf):
    grams = D.documents(spark, sf).select(F.explode(T.word_grams("text", 2)).alias("term")).distinct()
    return grams.filter(~P.is_noise("term", CFG)).select("term")


@query
def title_fragment_filter(spark, sf):
    titles = D.postings(spark, sf).select("posting_id", P.posting_title("text").alias("title"))
    cands = P.line_candidates(posting_lines(spark, sf), CFG).select("posting_id", "term").distinct()
    return cands.join(P.title_words(titles), ["posting_id", "term"], "left_anti")


@query
def weigh_terms(spark, sf):
    w = P.weigh_terms(P.term_candidates(D.postings(spark, sf), CFG))
    return w.select("posting_id", "term", _long("cnt"), (F.col("weight_c") / 100.0).alias("weight"), "required", "preferred", "tool")


@query
def prioritize_terms(spark, sf):
    t = terms(spark, sf)
    return t.select("posting_id", "term", "category", (F.col("score_c") / 100.0).alias("score"), "priority", _long("rank"))


@query
def term_views(spark, sf):
    t = terms(spark, sf)
    views = F.array(*[F.when(c(), F.lit(n)) for n, c in P.VIEWS.items()])
    return t.select("posting_id", "term", F.explode(F.filter(views, lambda v: v.isNotNull())).alias("view"))


@query
def years_required(spark, sf):
    o = D.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("Minimum "), k % 50, F.lit(" years. "), k % 7, F.lit("-"), k % 5, F.lit(" years; "), k % 9,
        F.lit("+ years of proven experience and "), k % 11, F.lit(" years spent in "), F.lower("o_orderstatus"), F.lit(" trade desks."))
    y = P.years_required(o.select(k.alias("posting_id"), text.alias("text")))
    return y.select("posting_id", _long("years"), "context")


@query
def cert_mentions(spark, sf):
    return P.cert_mentions(D.postings(spark, sf), D.CREDENTIALS)


@query
def soft_skill_mentions(spark, sf):
    return P.soft_skill_mentions(posting_lines(spark, sf), D.SOFT)


@query
def industry_mentions(spark, sf):
    return P.industry_mentions(posting_lines(spark, sf), D.INDUSTRIES)


@query
def action_verbs(spark, sf):
    return P.action_verbs(posting_lines(spark, sf), D.VERBS)


@query
def top_terms(spark, sf):
    return terms(spark, sf).filter("rank <= 10").select("posting_id", _long("rank"), "term")
