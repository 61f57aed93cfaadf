"""Findings ranked inside the row and regular expressions behind a plain test, against the general forms."""

import random

from pyspark.sql import functions as F

from termloom import fixed_values as fv
from termloom.operators import findings as N
from termloom.operators import postings as P
from termloom.operators import scores as S

INTS = ["n_bullets", "n_verb", "n_metric", "n_long", "n_dups", "n_skills", "n_core", "n_over", "n_literal", "n_synonym", "n_missing", "n_missing_high", "n_unsupported_tech",
        "title_ats", "ats_score", "job_score", "verb_pct", "readability"]


def test_top_findings_without_sorting_findings_of_other_pairs(spark):
    r = random.Random(3)
    rows = [(p, d, *[r.choice((None, 0, 1, 3, 5, 9, 40, 60, 90)) for _ in INTS]) for p in range(4) for d in range(40)]
    features = N.complete(spark.createDataFrame(rows, "posting_id int, doc_id int, " + ", ".join(f"{c} int" for c in INTS)).coalesce(3))
    cols = ["posting_id", "doc_id", "quadrant", "rank", "rule", "rule_no", "severity", "evidence"]
    got = lambda df: sorted(map(str, df.select(*cols).collect()))
    for k in (1, 3, fv.FINDINGS_PER_QUADRANT):
        mine = N.top_findings_of(features, k)
        assert got(mine) == got(N.top_findings(N.swot_findings(features), k)) and mine.count() > 0
        plan = mine._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    advice = N.recommendations(features)
    assert "Join" not in advice._jdf.queryExecution().optimizedPlan().toString()
    spoken = {(x.posting_id, x.doc_id) for x in advice.collect()}
    assert len(spoken) == len(rows)


def test_years_and_credentials_in_any_case(spark):
    texts = ["At LEAST 3 YEARS of it", "5+ Years experience", "no number of years", "2 - 4 yEaRs", None, "", "CPA certified and XY  certification", "cpa Certified", "seven 7 jahre"]
    docs = spark.createDataFrame(list(enumerate(texts)), "posting_id int, text string")
    assert sorted((x.posting_id, x.years) for x in P.years_required(docs).select("posting_id", "years").distinct().collect()) == [(0, 3), (1, 5), (3, 2)]
    assert sorted(map(tuple, P.cert_mentions(docs, {"cpa": "accountant"}).collect())) == [(6, "accountant"), (6, "cpa certified"), (6, "xy  certification"), (7, "accountant")]
    plan = P.years_required(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(lower(" in plan


def test_rollup_expands_counts_and_not_pairs(spark):
    r = random.Random(5)
    rows = [(p, r.choice("ab"), r.choice(("x", None)), r.randrange(101)) for p in range(3) for _ in range(400)]
    df = spark.createDataFrame(rows, "posting_id int, lang string, source string, score int").repartition(3)
    got = {(x.posting_id, x.lang, x.source, x.level): (x.n, x.mean_score, x.median, x.p90) for x in S.corpus_rollup(df, ["posting_id", "lang", "source"]).collect()}
    def at(v, q):
        i = (len(v) - 1) * q
        lo = int(i)
        return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (i - lo)
    v = sorted(s for *_, s in rows)
    whole = got[("ALL", "ALL", "ALL", 7)]
    assert whole[0] == 1200 and abs(whole[1] - sum(v) / 1200) < 1e-4 and whole[2] == at(v, 0.5) and abs(whole[3] - at(v, 0.9)) < 1e-4
    v = sorted(s for p, a, b, s in rows if p == 1 and a == "a" and b is None)
    assert got[("1", "a", "none", 0)][0] == len(v) and got[("1", "a", "none", 0)][2] == at(v, 0.5)
    expand = S.corpus_rollup(df, ["posting_id", "lang", "source"])._jdf.queryExecution().optimizedPlan().toString()
    assert expand.index("Expand") < expand.rindex("Aggregate")
