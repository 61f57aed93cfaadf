"""The composed rewrite of the documents each posting ranks: versions, change log, guard, scores before and after, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom import fixed_values as fv
from termloom.operators import compose as C
from termloom.operators import findings as N
from termloom.operators import postings as P
from termloom.operators import rewrite as R
from termloom.operators import scores as S
from termloom.operators import versions as V
from termloom.operators import match as M
from termloom.plans import corpus as D
from termloom.plans.match_jobs import evidence_of, insertable_of, pool, pool_evidence
from termloom.plans.posting_jobs import terms
from termloom.plans.registry import query
from termloom.plans.score_jobs import PAIR, bullets, order_scores, present, ranked_pairs, roles, skills, titles, wide_of
from termloom.plans.text_jobs import _long


def pair_matches(spark, sf):
    """Statuses of the pool terms for the ranked pairs, with what may be inserted and the rank of the term."""
    def build():
        m = M.match_status(pool(spark, sf), pool_evidence(spark, sf), ranked_pairs(spark, sf))
        rank = terms(spark, sf).select("posting_id", "term", "rank")
        return insertable_of(spark, m).join(rank, ["posting_id", "term"], "left").withColumn("rank", F.coalesce("rank", F.lit(100)))

    return D.stored(spark, sf, "pair_matches", build)


def ranked_docs(spark, sf):
    return ranked_pairs(spark, sf).select("doc_id").distinct()


def steps(spark, sf):
    lines = bullets(spark, sf).join(ranked_docs(spark, sf), "doc_id", "left_semi").select("doc_id", "bullet_no", "text", (F.col("bullet_no") % 2 == 0).alias("is_current"))
    return D.stored(spark, sf, "steps", lambda: C.document_steps(lines, D.OPENERS, D.LEVELS, D.TENSES))


def rows(spark, sf):
    def build():
        swaps = pair_matches(spark, sf).filter("can_insert and status = 'SYNONYM'").select(*PAIR, F.col("resume_term").alias("source"), F.col("term").alias("target"))
        return C.composed(ranked_pairs(spark, sf), steps(spark, sf), C.aligned_bullets(steps(spark, sf), swaps))

    return D.stored(spark, sf, "composed", build)


def summaries(spark, sf):
    first = roles(spark, sf).groupBy("doc_id").agg(F.min_by("role", "line_no").alias("role"))  # the role that stands first
    return R.draft_summary(first, pair_matches(spark, sf))


def promoted(spark, sf):
    docs = D.documents(spark, sf).join(ranked_docs(spark, sf), "doc_id", "left_semi")
    tok = docs.select("doc_id", F.array_distinct(F.split(F.lower("text"), "[^a-z0-9+#/]+")).alias("tokens"))
    p = R.promote_skills(pair_matches(spark, sf), pool_evidence(spark, sf).filter("mentions > 0"), skills(spark, sf), roles(spark, sf), tok)
    return p.filter("promoted").select(*PAIR, "term")


def both_versions(spark, sf):
    def build():
        certs = P.cert_mentions(D.documents(spark, sf), D.CREDENTIALS, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_set("term")).alias("certs"))
        fixed = certs.withColumns({"header": F.array().cast(C.HEADER), "schools": F.array().cast("array<string>")})
        return C.versions(rows(spark, sf), skills(spark, sf), promoted(spark, sf), summaries(spark, sf), fixed)

    return D.stored(spark, sf, "versions", build)


def log(spark, sf):
    return C.changes(rows(spark, sf), summaries(spark, sf), promoted(spark, sf))


def issues(spark, sf):
    m = pair_matches(spark, sf)
    lists = m.groupBy(*PAIR).agg(F.collect_set(F.when(F.col("status") == "MISSING", F.col("term"))).alias("missing"), F.collect_set(F.when(F.col("can_insert"), F.col("term"))).alias("allowed"))
    return C.guard_issues(both_versions(spark, sf), lists)


def verdicts(spark, sf):
    return V.guard_verdict(ranked_pairs(spark, sf), issues(spark, sf), PAIR)


@query
def rewrite_versions(spark, sf):
    v = both_versions(spark, sf)
    return v.select(*PAIR, C.version_text("before").alias("before"), C.version_text("after").alias("after"))


@query
def rewrite_log(spark, sf):
    return log(spark, sf).select(*PAIR, "section", "bullet_no", "type", "advice", "from", "to")


@query
def rewrite_issues(spark, sf):
    return issues(spark, sf).select(*PAIR, "rule", "severity", "term")


@query
def rewrite_guard(spark, sf):
    return verdicts(spark, sf).select(*PAIR, "passed", _long("n_critical"), _long("n_issues"))


def version_components(spark, sf):
    """All components of both versions of every ranked pair: (posting, doc, side, scale, ord, component, value, weight)."""
    def build():
        v = both_versions(spark, sf)
        sides = v.select(*PAIR, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("v"), C.version_text(s).alias("text")) for s in ("before", "after")])).alias("x"))
        keyed = D.stored(spark, sf, "sides", lambda: sides.select("posting_id", F.col("doc_id").alias("source_id"), F.concat_ws(":", "posting_id", "doc_id", "x.side").alias("doc_id"), "x.side", "x.text", "x.v"))
        docs, name = keyed.select("doc_id", "source_id", "text"), keyed.select("doc_id", "source_id")
        own = lambda df: name.join(df.withColumnRenamed("doc_id", "source_id"), "source_id").drop("source_id")
        lines = keyed.select("doc_id", F.lit("body").alias("section"), F.explode("v.bullets").alias("b")).select("doc_id", "section", F.col("b.no").alias("bullet_no"), F.col("b.text").alias("text"))
        items = keyed.select("doc_id", F.explode("v.skills").alias("item"))
        feats = S.doc_features(docs, lines, own(present(spark, sf)), own(order_scores(spark, sf)), items, D.VERBS)
        ev = evidence_of(spark, sf, pool(spark, sf), docs.select("doc_id", "text"))
        pairs = keyed.select("posting_id", "doc_id")
        source = own(pool_evidence(spark, sf).select("doc_id", "term"))
        w = D.stored(spark, sf, "version_features", lambda: wide_of(spark, sf, pairs, ev, docs, feats, source))
        both = S.components(w, S.ats_components(), fv.ATS_WEIGHTS, "ats").unionByName(S.components(w, S.job_components(), fv.JOB_WEIGHTS, "job"))
        return both.withColumnRenamed("doc_id", "version").join(keyed.select(F.col("doc_id").alias("version"), F.col("source_id").alias("doc_id"), "side"), "version").drop("version")

    return D.stored(spark, sf, "version_components", build)


def deltas(spark, sf):
    c = version_components(spark, sf)
    side = lambda s: c.filter(F.col("side") == s).drop("side")
    return V.version_pair(side("before"), side("after"), [*PAIR, "scale", "ord"])


@query
def rewrite_delta(spark, sf):
    """The 15 components of both versions."""
    return deltas(spark, sf).select(*PAIR, "scale", "component", _long("before"), _long("after"), _long("delta"), "unmoved")


def report(spark, sf, findings):
    c = version_components(spark, sf).filter("side = 'after'")
    score = lambda scale, bands, low: S.overall(c.filter(F.col("scale") == scale), bands, low)
    a = score("ats", fv.ATS_BANDS, "weak").select(*PAIR, F.col("score").alias("ats_score"))
    numbered = log(spark, sf).filter("not advice").withColumn("change_no", F.struct(F.coalesce("bullet_no", F.lit(1 << 40)), "section", "type", "to"))
    return N.build_report(score("job", fv.JOB_BANDS, "low").join(a, PAIR), deltas(spark, sf), findings, pair_matches(spark, sf), titles(spark, sf), numbered, verdicts(spark, sf))
