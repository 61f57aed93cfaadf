"""Version jobs: turns of stored conversations as versions of a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import match as M
from termloom.operators import scores as S
from termloom.operators import versions as V
from termloom.plans import corpus as D
from termloom.plans.posting_jobs import terms
from termloom.plans.registry import query
from termloom.plans.score_jobs import bullets, features
from termloom.plans.text_jobs import _long

K = ["conv_id", "turn"]


def turns(spark, sf):
    return V.consecutive(D.table(spark, sf, "conversations"), "conv_id", "turn")


def all_versions(spark, sf):
    """Turns, and successive documents of the store as versions -1 of each other."""
    docs = D.documents(spark, sf).select("doc_id", "text", F.col("doc_id").alias("conv_id"))
    succ = docs.select("conv_id", F.col("text").alias("before")).join(
        docs.select((F.col("conv_id") - 1).alias("conv_id"), F.col("text").alias("after")), "conv_id")
    return turns(spark, sf).unionByName(succ.withColumn("turn", F.lit(-1).cast("long")))


@query
def new_numbers(spark, sf):
    return V.new_numbers(all_versions(spark, sf), K)


@query
def new_entities(spark, sf):
    return V.new_entities(all_versions(spark, sf), K)


def leaked(spark, sf):
    t = turns(spark, sf)
    wanted = terms(spark, sf).select("term").distinct()
    hits = lambda c: M.term_hits(t.select(*K, F.col(c).alias("text")), wanted, K)
    return V.leaked_terms(hits("before"), hits("after"), wanted, K)


@query
def leaked_terms(spark, sf):
    return leaked(spark, sf).select(*K, "term", "severity")


@query
def guard_verdict(spark, sf):
    t = turns(spark, sf)
    issues = V.new_numbers(t, K).unionByName(V.new_entities(t, K)).unionByName(leaked(spark, sf))
    return V.guard_verdict(t, issues, K).select(*K, "passed", _long("n_critical"), _long("n_issues"))


def header_versions(spark, sf):
    o = D.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("entry_no"), F.col("o_orderpriority").alias("role"),
        F.col("o_orderstatus").alias("company"))
    k = F.col("entry_no")
    after = o.withColumn("role", F.when(k % 10 == 0, F.concat(F.lit("Senior "), "role")).otherwise(F.upper("role"))).withColumn(
        "company", F.when(k % 15 == 0, F.lit("X")).otherwise(F.col("company")))
    return o, after


@query
def changed_header(spark, sf):
    b, a = header_versions(spark, sf)
    return V.changed_header(b, a, ["doc_id", "entry_no"]).select("doc_id", "entry_no", "rule", "term")


@query
def added_certs(spark, sf):
    b, a = header_versions(spark, sf)
    return V.added_items(b, a, ["doc_id"], "role", "certification-added").select("doc_id", "rule", "term").distinct()


@query
def added_education(spark, sf):
    b, a = header_versions(spark, sf)
    return V.added_items(b, a, ["doc_id"], "company", "education-added").select("doc_id", "rule", "term").distinct()


@query
def added_skills(spark, sf):
    t = turns(spark, sf)
    words = F.filter(F.split(F.lower("after"), "[^a-z]+"), lambda w: w != "")
    skills = t.select(*K, F.explode(F.array_distinct(words)).alias("item"))
    wanted = skills.select(F.col("item").alias("term")).distinct()
    hits = M.term_hits(t.select(*K, F.col("before").alias("text")), wanted, K)
    allowed = t.select(*K, F.lit("the").alias("term"))
    return V.added_skills(skills, hits, allowed, K).select(*K, "term")


@query
def word_diff_stats(spark, sf):
    return V.word_diff_stats(turns(spark, sf), K).select(*K, _long("added"), _long("removed"))


@query
def diff_totals(spark, sf):
    s = V.diff_totals(V.word_diff_stats(turns(spark, sf), K), "conv_id")
    return s.select("conv_id", _long("added"), _long("removed"), _long("changed"))


@query
def field_diff(spark, sf):
    b, a = header_versions(spark, sf)
    return V.field_diff(b, a, ["doc_id", "entry_no"], ["role", "company"]).select("doc_id", "entry_no", "field", "from", "to")


def turn_components(spark, sf):
    conv = D.table(spark, sf, "conversations")
    lines = conv.select(*K, F.explode(F.split("text", "\n")).alias("t")).select(*K, T.collapse_ws("t").alias("text")).filter("text <> ''")
    f = S.bullet_features(lines, D.VERBS, K)
    return S.components(f, {"actionVerbs": S.verb_share(), "readability": S.readability()}, {"actionVerbs": 11, "readability": 9}, "ats", K)


@query
def score_delta(spark, sf):
    c = turn_components(spark, sf).select(*K, "component", "value")
    p = V.version_pair(c, c.withColumn("turn", F.col("turn") - 1), K)
    return p.select(*K, "component", _long("before"), _long("after"), _long("delta"), "unmoved")


@query
def version_pair(spark, sf):
    """Document components before and after repeated lines are dropped."""
    f = features(spark, sf)
    c = S.components(f, {"duplicateContent": S.duplicate_score(), "readability": S.readability()}, {"duplicateContent": 8, "readability": 9}, "ats", ["doc_id"])
    after = S.components(f.withColumn("n_dups", F.lit(0)), {"duplicateContent": S.duplicate_score(), "readability": S.readability()},
                         {"duplicateContent": 8, "readability": 9}, "ats", ["doc_id"])
    return V.version_pair(c, after, ["doc_id"]).select("doc_id", "component", _long("before"), _long("after"), _long("delta"))


@query
def pair_bullets(spark, sf):
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: T.collapse_ws(x)), lambda x: x != "")
    t = turns(spark, sf).select(*K, lines("before").alias("before"), lines("after").alias("after"))
    return V.pair_bullets(t, K).select(*K, "kind", _long("from_no"), _long("to_no"), "sim")


@query
def near_dup_bullets(spark, sf):
    b = bullets(spark, sf).drop("section")
    return V.near_dup_bullets(b).filter("dropped").select("doc_id", _long("bullet_no"))
