"""Matching jobs: posting terms against stored documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom import dims
from termloom.functions import text as T
from termloom.operators import lines as L
from termloom.operators import match as M
from termloom.operators import postings as P
from termloom.plans import corpus as D
from termloom.plans.posting_jobs import CFG, terms
from termloom.plans.registry import query
from termloom.plans.structure_jobs import segmented
from termloom.session import write_once
from termloom.plans.text_jobs import _long, _vocabulary


ALLOWED = {"thing": ["edth"], "thti": ["hation"]}  # source -> targets it may be rewritten to


def user_keywords(spark, sf):
    kws = F.array(*[F.lit(k) for k in D.USER_KEYWORDS])
    k = D.postings(spark, sf).select("posting_id", F.posexplode(kws).alias("pos", "keyword"))
    return k.groupBy("posting_id", F.lower("keyword").alias("k")).agg(F.min_by("keyword", "pos").alias("keyword"), F.min("pos").alias("pos")).drop("k")


def pool(spark, sf):
    """Written once: its size is known to the joins that pair it with evidence."""
    return D.stored(spark, sf, "pool", lambda: M.target_pool(terms(spark, sf), user_keywords(spark, sf)))


def expanded(spark, wanted):
    return M.expand_terms(wanted, dims.synonym_dim(spark, D.SYNONYMS), dims.credential_dim(spark, D.CREDENTIALS))


def pool_evidence(spark, sf):
    """Evidence for the whole target pool: the fact table of every later job."""
    return D.stored(spark, sf, "evidence", lambda: evidence_of(spark, sf, pool(spark, sf)))


def term_evidence(spark, sf):
    return pool_evidence(spark, sf).join(terms(spark, sf).select("term").distinct(), "term", "left_semi")


def evidence_of(spark, sf, wanted, docs=None, keys=("doc_id",)):
    """Evidence of the wanted terms in whole-word mode plus the any-order rule."""
    docs = D.document_pieces(spark, sf) if docs is None else write_once(T.with_marks(docs).select(*keys, "pieces"), "pieces")
    exp = write_once(expanded(spark, wanted), "variants")
    variants = exp.select(F.col("variant").alias("term")).distinct()
    hits = M.term_hits(docs, variants, keys)
    unordered = M.term_hits_unordered(docs, variants, D.STOPS, keys)
    return M.evidence(exp, hits, unordered, keys)


@query
def target_pool(spark, sf):
    return pool(spark, sf).select("posting_id", "term", "display", "source", "priority")


@query
def expand_terms(spark, sf):
    wanted = terms(spark, sf).select("term").unionByName(_vocabulary(spark, sf).select(F.col("word").alias("term")))
    return expanded(spark, wanted).select("term", "variant", _long("ord"))


@query
def term_hits(spark, sf):
    h = M.term_hits(D.documents(spark, sf).select("doc_id", "text"), terms(spark, sf).select("term").distinct())
    return h.select("doc_id", "term", _long("mentions"))


@query
def term_hits_substring(spark, sf):
    h = M.term_hits_substring(D.documents(spark, sf).select("doc_id", "text"), terms(spark, sf).select("term").distinct())
    return h.select("doc_id", "term", _long("mentions"))


@query
def term_hits_unordered(spark, sf):
    return M.term_hits_unordered(D.documents(spark, sf).select("doc_id", "text"), terms(spark, sf).select("term").distinct(), D.STOPS)


def matches(spark, sf):
    p = pool(spark, sf)
    ev = pool_evidence(spark, sf)
    return M.match_status(p, ev, M.candidate_pairs(p, ev))


def insertable_of(spark, rows):
    return M.with_insertable(rows, dims.substitution_dim(spark, ALLOWED), dims.synonym_dim(spark, D.SYNONYMS))


def insertable_hits(spark, sf):
    """Evidenced rows of all pairs; what may be inserted is decided on the evidence, before it meets the postings."""
    return M.evidenced(pool(spark, sf), insertable_of(spark, pool_evidence(spark, sf)))


@query
def match_status(spark, sf):
    return matches(spark, sf).select("posting_id", "doc_id", "term", "source", "priority", "status", _long("mentions"), "resume_term")


@query
def missing_terms(spark, sf):
    p = pool(spark, sf)
    category = terms(spark, sf).select("posting_id", "term", "category")
    wanted = p.select("posting_id", "term").join(category, ["posting_id", "term"], "left").withColumn("category", F.coalesce("category", F.lit("other")))
    m = M.missing_lists(p, pool_evidence(spark, sf), wanted, ["term"])
    return m.select("posting_id", "doc_id", F.explode("missing").alias("m")).select("posting_id", "doc_id", "m.term", "m.category")


@query
def evidence_docs(spark, sf):
    jd = terms(spark, sf)
    docs = D.documents(spark, sf)
    return M.evidence_docs(docs, term_evidence(spark, sf), P.term_view(jd, "tools")).select("doc_id", "source")


@query
def match_locations(spark, sf):
    seg = segmented(spark, sf).filter(F.col("section_id").isNotNull() & F.col("in_body"))
    texts = seg.groupBy("doc_id", "section_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n").alias("text"))
    ev = evidence_of(spark, sf, terms(spark, sf), texts, ("doc_id", "section_id"))
    return M.match_locations(ev)


@query
def can_substitute(spark, sf):
    v = expanded(spark, _vocabulary(spark, sf).select(F.col("word").alias("term")))
    pairs = v.select(F.col("variant").alias("source"), F.col("term").alias("target")).unionByName(
        v.select(F.col("term").alias("source"), F.col("variant").alias("target"))).distinct()
    return M.can_substitute(pairs, dims.substitution_dim(spark, ALLOWED), dims.synonym_dim(spark, D.SYNONYMS))


@query
def match_summary(spark, sf):
    s = M.summary_of(pool(spark, sf), insertable_hits(spark, sf))
    return s.select("posting_id", "doc_id", *[_long(c) for c in ("targets", "matched", "literal", "via_synonym", "missing", "coverage", "insertable")])


@query
def repeated_terms(spark, sf):
    r = M.repeated_terms(term_evidence(spark, sf))
    return r.select("doc_id", "term", _long("mentions"), "level")


@query
def term_demand(spark, sf):
    p = pool(spark, sf)
    docs = D.documents(spark, sf)
    total = docs.agg(F.count(F.lit(1))).scalar()
    return M.term_demand(p, pool_evidence(spark, sf), total).select("term", _long("n_postings"), _long("n_docs"), _long("n_missing"))
