"""Jobs over all pairs that share a term, held against the general operators that build every (pair, term) row."""

from pyspark.sql import functions as F

from termloom.operators import match as M
from termloom.operators import rewrite as R
from termloom.operators import versions as V
from termloom.plans import corpus as D
from termloom.plans import score_jobs
from termloom.plans.structure_jobs import segmented

SF = "/root/testdata/sf0.001"
rows = lambda df, *cols: sorted(tuple(r) for r in df.select(*cols).collect())


def tables(spark):
    pool = spark.createDataFrame([(p, t, "jd", pr, r) for p, t, pr, r in [
        (1, "sql", "HIGH", 1), (1, "java", "LOW", 2), (1, "excel", "HIGH", 3), (2, "go", "HIGH", 1), (2, "sql", "MEDIUM", 2), (3, "rust", "HIGH", 1)]],
        "posting_id int, term string, source string, priority string, rank int")
    ev = spark.createDataFrame([(1, "sql", "MATCHED", 2, "sql", False), (1, "excel", "SYNONYM", 0, "sheets", True), (2, "go", "MATCHED", 1, "go", False), (3, "none", "MATCHED", 1, "none", False)],
                               "doc_id int, term string, status string, mentions int, resume_term string, can_insert boolean")
    return pool, ev


def test_hits_are_the_matches_that_are_not_missing(spark):
    pool, ev = tables(spark)
    every = M.match_status(pool, ev, M.candidate_pairs(pool, ev)).withColumn("can_insert", F.coalesce("can_insert", F.lit(False)))
    hits = M.evidenced(pool, ev)
    cols = ["posting_id", "doc_id", "term", "status", "mentions", "resume_term"]
    assert rows(hits, *cols) == rows(every.filter("status <> 'MISSING'"), *cols)
    want = M.match_summary(every)
    assert rows(M.summary_of(pool, hits), *want.columns) == rows(want, *want.columns)
    lists = M.missing_lists(pool, ev, pool.select("posting_id", "term", "priority"), ["priority", "term"])
    got = lists.select("posting_id", "doc_id", F.explode("missing").alias("m")).select("posting_id", "doc_id", "m.term", "m.priority")
    assert rows(got, *got.columns) == rows(every.filter("status = 'MISSING'"), *got.columns)


def test_skills_look_their_rank_up_in_the_pool(spark):
    pool, ev = tables(spark)
    skills = spark.createDataFrame([(1, 0, "Java"), (1, 0, "SQL"), (1, 0, "paint"), (2, 0, "sql"), (9, 0, "sql")], "doc_id int, group_no int, item string")
    every = M.match_status(pool, ev, M.candidate_pairs(pool, ev))
    cols = ["posting_id", "doc_id", "group_no", "item", "demand", "position"]
    want = R.skills_by_demand(every.select("posting_id", "doc_id").distinct().join(skills, "doc_id"), every)
    assert rows(R.skills_by_pool(skills, pool, ev), *cols) == rows(want, *cols) and want.count() > 0


def test_components_of_terms_need_no_titles_or_document_features(spark):
    D.forget()
    for q in (score_jobs.missing_score, score_jobs.required_coverage, score_jobs.unsupported_score, score_jobs.posting_language, score_jobs.title_alignment):
        q(spark, SF)
    assert not {n for _, _, n in D._stored} & {"pair_features", "features", "segmented"}
    D.forget()


def test_lines_are_not_shuffled_by_heading(spark, monkeypatch):
    D.forget()
    plans = {}
    keep = D.write_once
    monkeypatch.setattr(D, "write_once", lambda df, name: plans.setdefault(name, df) and keep(df, name))
    segmented(spark, SF)
    plan = plans["segmented"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1  # the texts are read once, not again for each table of headings
    D.forget()


def test_grams_are_no_stored_column_and_only_shared_probes_are_joined(spark, monkeypatch):
    seen = {}
    keep = V.write_once
    monkeypatch.setattr(V, "write_once", lambda df, name: seen.setdefault(name, keep(df, name)))
    text = "the quick brown fox jumps over the lazy dog again and again"
    b = spark.createDataFrame([(1, 0, text), (1, 1, text + "s"), (1, 2, "short line of words"), (2, 0, text)], "doc_id int, bullet_no int, text string")
    assert [(r.doc_id, r.bullet_no) for r in V.near_dup_bullets(b).filter("dropped").collect()] == [(1, 0)]
    assert "grams" not in seen["near_rows"].columns
    assert {(r.doc_id, r.no) for r in seen["shared_probes"].collect()} == {(1, 0), (1, 1)}
