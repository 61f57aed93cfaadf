"""Clean-up, findings and report jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom import fixed_values as fv
from termloom.functions import text as T
from termloom.operators import entries as E
from termloom.operators import findings as N
from termloom.operators import match as M
from termloom.operators import postings as P
from termloom.operators import rewrite as R
from termloom.operators import scores as S
from termloom.operators import windows as W
from termloom.plans import compose_jobs as CJ
from termloom.plans import corpus as D
from termloom.plans.match_jobs import insertable_hits, insertable_of, pool, pool_evidence
from termloom.plans.posting_jobs import posting_lines, terms
from termloom.plans.registry import query
from termloom.plans.score_jobs import bullets, flags, present, ranked_pairs, roles, skills, wide
from termloom.plans.text_jobs import _long
from termloom.session import write_once

PAIR = ["posting_id", "doc_id"]


def duty_bullets(spark, sf):
    """Bullets written from the orders table, with weak openers, tense and spelling to fix."""
    o = D.table(spark, sf, "orders")
    openers = ["Responsible for", "Handled", "Tasked with the", "helped with", "Manage", "Looked after", "A large number of a", "In the event that our"]
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("doc_id"), k.alias("bullet_no"), (k % 2 == 0).alias("is_current"),
        F.concat(F.element_at(F.array(*[F.lit(x) for x in openers]), (k % len(openers) + 1).cast("int")), F.lit(" order "), F.lower("o_orderpriority"),
                 F.lit(" , for the purpose of seperate review")).alias("text"))


@query
def clean_bullets(spark, sf):
    lines = bullets(spark, sf).select("doc_id", "bullet_no", "text")
    return R.clean_bullets(lines).select("doc_id", _long("bullet_no"), "clean")


@query
def upgrade_verbs(spark, sf):
    return R.upgraded_bullets(duty_bullets(spark, sf)).select("doc_id", "bullet_no", "upgraded", "advice")


@query
def normalize_tense(spark, sf):
    return R.normalize_tense(duty_bullets(spark, sf)).select("doc_id", "bullet_no", "tensed")


def changes(spark, sf):
    rows, advice = R.compose_bullets(duty_bullets(spark, sf))
    return R.change_log(rows, ["doc_id", "bullet_no"], advice=advice)


@query
def change_log(spark, sf):
    return changes(spark, sf).select("doc_id", "bullet_no", "type", "advice", "from", "to")


@query
def change_summary(spark, sf):
    return R.change_summary(changes(spark, sf)).select("type", "advice", _long("n"))


@query
def drop_short(spark, sf):
    return R.drop_short(bullets(spark, sf)).select("doc_id", _long("bullet_no"))


def insertable(spark, sf):
    """Evidenced terms of all pairs with what may be inserted and the rank of the term."""
    return insertable_hits(spark, sf).join(
        ranks(spark, sf), ["posting_id", "term"], "left").withColumn("rank", F.coalesce("rank", F.lit(100)))


def ranks(spark, sf):
    return terms(spark, sf).select("posting_id", "term", "rank")


@query
def align_terms(spark, sf):
    swaps = insertable(spark, sf).filter("can_insert and status = 'SYNONYM'").select(*PAIR, F.col("resume_term").alias("source"), F.col("term").alias("target"))
    a = R.align_terms(bullets(spark, sf).select("doc_id", "bullet_no", "text"), swaps, PAIR)
    return a.filter("aligned <> text").select(*PAIR, _long("bullet_no"), "aligned")


@query
def substitution_gain(spark, sf):
    c = insertable(spark, sf).filter("can_insert and status = 'SYNONYM'").select(*PAIR, F.col("resume_term").alias("source"), F.col("term").alias("target"))
    g = R.substitution_gain(D.documents(spark, sf), c, pool(spark, sf), D.STOPS)
    return g.select(*PAIR, "source", "target", _long("gain"), _long("rank"))


@query
def skills_by_demand(spark, sf):
    wanted = pool(spark, sf).select("posting_id", "term").join(ranks(spark, sf), ["posting_id", "term"], "left").withColumn("rank", F.coalesce("rank", F.lit(100)))
    return R.skills_by_pool(skills(spark, sf), wanted, pool_evidence(spark, sf)).select(*PAIR, _long("group_no"), "item", _long("demand"), _long("position"))


@query
def promote_skills(spark, sf):
    docs = D.documents(spark, sf)
    tok = docs.select("doc_id", F.array_distinct(F.split(F.lower("text"), "[^a-z0-9+#/]+")).alias("tokens"))
    p = R.promote_skills(insertable(spark, sf), pool_evidence(spark, sf).filter("mentions > 0"), skills(spark, sf), roles(spark, sf), tok)
    return p.select(*PAIR, "term", "promoted", "reason")


@query
def draft_summary(spark, sf):
    r = roles(spark, sf).groupBy("doc_id").agg(F.min_by("role", "line_no").alias("role"))  # the role that stands first
    return R.draft_summary(r, insertable(spark, sf))


def feature_row(spark, sf, pairs=None):
    """All inputs of the rules per pair that shares a term, or per pair of ``pairs``."""
    cat = terms(spark, sf).select("posting_id", "term", "category", "required")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    facts = pool(spark, sf).join(cat, ["posting_id", "term"], "left").select(
        "posting_id", "term", F.lit(1).alias("missing"), yes((F.col("priority") == "HIGH") | (F.col("source") == "user")).alias("missing_high"),
        yes(F.col("category") == "technology").alias("unsupported_tech"), yes(F.col("required")).alias("absent_required"))
    names = [c for c in facts.columns if c not in ("posting_id", "term")]
    # what is missing is what the posting wants less what the pair has
    wanted = write_once(facts.groupBy("posting_id").agg(*[F.sum(c).alias(f"_t_{c}") for c in names]), "wanted_facts")
    synonym = F.col("status") == "SYNONYM"
    counted = {f"_h_{c}": F.col(c) for c in names} | {
        "n_literal": F.col("status") == "MATCHED", "n_synonym": synonym, "n_insertable_synonym": synonym & F.col("can_insert")}
    marks = insertable_of(spark, pool_evidence(spark, sf)).select("doc_id", "term", "status", "can_insert")
    w = wide(spark, sf, marks, flags(spark, sf).join(facts, ["posting_id", "term"]), counted, pairs).join(wanted, "posting_id")
    w = w.withColumns({f"n_{c}": F.col(f"_t_{c}") - F.col(f"_h_{c}") for c in names} | {
        "ats_score": S.overall_score(S.ats_components(), fv.ATS_WEIGHTS), "job_score": S.overall_score(S.job_components(), fv.JOB_WEIGHTS),
        "weakest_value": F.shiftright(S.weakest_code(S.ats_components()), 7), "verb_pct": F.col("doc_verbs"), "readability": F.col("doc_readability")})
    docs = D.documents(spark, sf).select("doc_id", "text")
    asked, held = P.cert_mentions(D.postings(spark, sf), D.CREDENTIALS), P.cert_mentions(docs, D.CREDENTIALS, "doc_id")
    preferred = terms(spark, sf).filter("preferred").select("posting_id", "term")
    post = N.posting_inputs(P.years_required(D.postings(spark, sf)), asked, preferred, P.industry_mentions(posting_lines(spark, sf), D.INDUSTRIES))
    own = N.document_inputs(P.years_required(docs, "doc_id"), held, E.text_layout(docs), present(spark, sf))
    n = CJ.log(spark, sf).filter("not advice").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_changes"))
    return N.assemble(w, post, own, asked, held, write_once(CJ.verdicts(spark, sf), "verdicts"), write_once(n, "n_changes"))


@query
def recommendations(spark, sf):
    return N.recommendations(feature_row(spark, sf)).select(*PAIR, "rule", "severity", "evidence")


@query
def swot_findings(spark, sf):
    return N.swot_findings(feature_row(spark, sf)).select(*PAIR, "quadrant", "rule", "severity", "evidence")


@query
def top_findings(spark, sf):
    t = N.top_findings_of(feature_row(spark, sf))
    return t.select(*PAIR, "quadrant", _long("rank"), "rule")


@query
def years_gap(spark, sf):
    """Customers as documents, orders as postings: span of the entries against the years asked."""
    from termloom.plans.score_jobs import customer_entries

    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("posting_id"), F.col("o_custkey").alias("doc_id"), F.concat(
        F.lit("At least "), F.col("o_orderkey") % 12, F.lit(" years")).alias("text"))
    spans = W.experience_span(customer_entries(spark, sf), 2024)
    g = N.years_gap(P.years_required(o), spans, o.select(*PAIR))
    return g.select(*PAIR, _long("years_required"), _long("years_shown"))


@query
def write_report(spark, sf):
    """Nested report rows of the rewritten pairs as JSON text, the form the sink writes."""
    r = CJ.report(spark, sf, N.top_findings_of(feature_row(spark, sf, ranked_pairs(spark, sf))))  # of the pairs it reports
    return r.select(*PAIR, F.to_json(F.struct(*[c for c in r.columns if c not in PAIR])).alias("report"))
