"""Meaning of the rules on small hand-written rows."""

import pytest
from pyspark.sql import functions as F

from termloom import dims
from termloom import fixed_values as fv
from termloom.functions import text as T
from termloom.operators import findings as N
from termloom.operators import match as M
from termloom.operators import postings as P
from termloom.operators import rewrite as R
from termloom.operators import scores as S
from termloom.operators import versions as V
from termloom.sources import readers


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_weights_sum_to_one():
    assert sum(fv.ATS_WEIGHTS.values()) == 100 and sum(fv.JOB_WEIGHTS.values()) == 100


@pytest.mark.parametrize("raw,want", [("January 2020 - now", "Jan 2020 - Present"), ("03/2020", "Mar 2020"), ("2019–2021", "2019 - 2021"), ("2018", "2018")])
def test_normalize_dates(spark, raw, want):
    assert one(spark, T.normalize_dates(F.lit(raw))) == want


def test_triage_files(spark):
    rows = [("a.pdf", 100, b"%PDF-1.7"), ("b.docx", 100, b"PK\x03\x04...."), ("c.pdf", 100, b"PK\x03\x04...."), ("d.pdf", 100, b"nonsense"),
            ("e.docx", 100, b"%PDF-1.7"), ("f.docx", 100, bytes.fromhex(fv.OLE_MAGIC_HEX)), ("g.docx", 100, b"nonsense"), ("h.txt", 100, b"x"),
            ("i.pdf", 0, b""), ("j.pdf", 10, b"%PDF-1.7"), ("k.pdf", fv.MAX_FILE_BYTES + 1, b"%PDF-1.7")]
    df = spark.createDataFrame([(p, n, bytearray(c)) for p, n, c in rows], "path string, length long, content binary")
    got = [r.code for r in readers.triage_files(df).orderBy("path").collect()]
    assert got == ["ok", "ok", "wrong-format", "corrupt-pdf", "wrong-format", "legacy-doc", "corrupt-docx", "unsupported-format", "empty-file", "file-too-small", "file-too-large"]


POSTING = """Stock Planner - Leeds (Hybrid)

Responsibilities
- Own demand planning and forecast accuracy for 40+ stores

Requirements
- 3+ years of experience in supply chain
- Strong Excel capability and sql
- CSCP certification

Nice to have
- Python exposure"""


@pytest.fixture(scope="module")
def jd(spark):
    posts = spark.createDataFrame([("p", POSTING)], "posting_id string, text string")
    return posts, P.posting_terms(posts, P.PostingConfig()).cache()


def test_posting_analysis(spark, jd):
    posts, terms = jd
    assert posts.select(P.posting_title("text")).first()[0] == "Stock Planner"
    assert {r.years for r in P.years_required(posts).collect()} == {3}
    by = {r.term: r for r in terms.collect()}
    assert "excel" in by and by["excel"].category == "domain-skill" and by["excel"].required
    assert "certified supply chain professional" in by
    assert not any("leeds" in t or "hybrid" in t for t in by)


def test_match_status_synonym_and_credential(spark, jd):
    _, terms = jd
    docs = spark.createDataFrame([(1, "Built spreadsheets. Holds CSCP. Sources data with sql"), (2, "nothing of it")], "doc_id long, text string")
    pool = M.target_pool(terms)
    exp = M.expand_terms(pool, dims.synonym_dim(spark), dims.credential_dim(spark))
    variants = exp.select(F.col("variant").alias("term")).distinct()
    ev = M.evidence(exp, M.term_hits(docs, variants), M.term_hits_unordered(docs, variants, dims.STOP_WORDS))
    pairs = spark.createDataFrame([("p", 1), ("p", 2)], "posting_id string, doc_id long")
    m = {(r.doc_id, r.term): (r.status, r.resume_term) for r in M.match_status(pool, ev, pairs).collect()}
    assert m[(1, "excel")] == ("SYNONYM", "spreadsheets")
    assert m[(1, "certified supply chain professional")][0] == "SYNONYM"
    assert all(s == "MISSING" for (d, _), (s, _) in m.items() if d == 2)
    for r in M.match_summary(M.with_insertable(M.match_status(pool, ev, pairs), dims.substitution_dim(spark), dims.synonym_dim(spark))).collect():
        assert r.insertable == (1 if r.doc_id == 1 else 0)  # spreadsheets may become excel
        assert r.literal + r.via_synonym + r.missing == r.targets


def test_word_hits_are_substring_hits(spark):
    docs = spark.createDataFrame([(1, "mysql and sql, stock plans. Planning stock"), (2, "plan")], "doc_id long, text string")
    terms = spark.createDataFrame([("sql",), ("stock plan",), ("plan",)], "term string")
    word = {(r.doc_id, r.term) for r in M.term_hits(docs, terms).collect()}
    sub = {(r.doc_id, r.term): r.mentions for r in M.term_hits_substring(docs, terms).collect()}
    assert word <= set(sub) and sub[(1, "sql")] == 2 and (1, "stock plan") in word


def test_claim_level(spark):
    b = spark.createDataFrame([(1, "Responsible for the depot"), (2, "Handled returns"), (3, "helped with audits")], "bullet_no int, text string")
    rows, advice = R.upgrade_verbs(b)
    got = [r.upgraded for r in rows.orderBy("bullet_no").collect()]
    assert got == ["Managed the depot", "Handled returns", "supported audits"]
    assert [r.bullet_no for r in advice.collect()] == [2]


def test_align_and_gain(spark):
    b = spark.createDataFrame([(1, 1, "Purchasing of parts and purchasing rules")], "doc_id int, bullet_no int, text string")
    a = spark.createDataFrame([(1, "purchasing", "procurement")], "doc_id int, source string, target string")
    assert R.align_terms(b, a).first().aligned == "Procurement of parts and purchasing rules"
    docs = spark.createDataFrame([(1, "Purchasing of parts and purchasing rules")], "doc_id int, text string")
    cand = a.withColumn("posting_id", F.lit("p"))
    pool = spark.createDataFrame([("p", "procurement"), ("p", "purchasing")], "posting_id string, term string")
    assert R.substitution_gain(docs, cand, pool, []).first().gain == 1


def test_guard(spark):
    p = spark.createDataFrame([(1, "Cut cost by 10% in 2020", "Cut cost by 12% in 2020 with Big Co"), (2, "same 5", "same 5")], "k int, before string, after string")
    issues = V.new_numbers(p, ["k"]).unionByName(V.new_entities(p, ["k"]))
    assert {(r.rule, r.term) for r in issues.collect()} == {("new-number", "12%"), ("new-term", "big co")}
    v = {r.k: r.passed for r in V.guard_verdict(p, issues, ["k"]).collect()}
    assert v == {1: False, 2: True}


def test_near_dups_against_brute_force(spark):
    texts = ["the quick brown fox jumps over the dog", "the quick brown fox jumped over the dog", "a wholly different line of text here", "ha ha ha ha ha ha ha ha ha ha",
             "ha ha ha ha ha ha ha ha ha hb", "short one", "short one", "planning stock for forty stores in the north", "xplanning stock for forty stores in the north"]
    b = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, bullet_no int, text string")
    got = {r.bullet_no for r in V.near_dup_bullets(b).filter("dropped").collect()}

    def lev(a, c):
        prev = list(range(len(c) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(c, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    want = set()
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            if i != j and (len(y), -j) > (len(x), -i):
                near = x == y or 1 - lev(x, y) / max(len(x), len(y)) > 0.9
                if near:
                    want.add(i)
    assert got == want


def test_finding_thresholds(spark):
    base = dict(posting_id=1, doc_id=1, n_bullets=10, n_verb=8, n_metric=5, n_long=0, n_dups=0, n_skills=8, title_ats=45, n_missing_high=0, n_unsupported_tech=0,
                n_literal=0, n_synonym=0, n_core=4, verb_pct=65, readability=60, job_score=55, ats_score=69, n_over=0, n_missing=9)
    at = N.complete(spark.createDataFrame([base]))
    assert [r.rule for r in N.recommendations(at).collect()] == ["clean"]
    assert {r.rule for r in N.swot_findings(at).filter("quadrant = 'weakness'").collect()} == set()
    below = N.complete(spark.createDataFrame([{**base, "n_verb": 7, "n_skills": 7, "title_ats": 44, "readability": 59, "job_score": 44, "n_missing": 10}]))
    assert {r.rule for r in N.recommendations(below).collect()} == {"weak-verbs", "thin-skills", "title-gap"}
    assert {r.rule for r in N.swot_findings(below).filter("quadrant = 'threat'").collect()} == {"lowmatch", "gapvolume"}


def test_components_in_range(spark):
    f = spark.createDataFrame([(1, 2, 1, 1, 0, 0, 0, 1, 30)], "doc_id int, n_bullets int, n_verb int, n_ideal int, n_long int, n_short int, n_passive int, n_metric int, sum_words int")
    c = S.components(f, {"actionVerbs": S.verb_share(), "readability": S.readability()}, fv.ATS_WEIGHTS, "ats", ["doc_id"])
    assert {r.component: r.value for r in c.collect()} == {"actionVerbs": 50, "readability": 70}


def test_draft_summary_states_no_number(spark):
    m = spark.createDataFrame([("p", 1, t, "MATCHED", "HIGH", "jd", False, i) for i, t in enumerate(["sql dashboards", "stock planning"])],
                              "posting_id string, doc_id int, term string, status string, priority string, source string, can_insert boolean, rank int")
    roles = spark.createDataFrame([(1, "Data Analyst")], "doc_id int, role string")
    assert R.draft_summary(roles, m).first().text == "Data Analyst with experience in sql dashboards and stock planning."


def test_report_is_written(spark, tmp_path):
    keys = "posting_id string, doc_id int"
    scores = spark.createDataFrame([("p", 1, 70, "strong")], keys + ", score int, band string")
    comps = spark.createDataFrame([("p", 1, "ats", 0, "readability", 50, 60, 10)], keys + ", scale string, ord int, component string, before int, after int, delta int")
    finds = spark.createDataFrame([("p", 1, "strength", 1, "skills", "low", "12")], keys + ", quadrant string, rank int, rule string, severity string, evidence string")
    m = spark.createDataFrame([("p", 1, "MATCHED", "sql", "HIGH", "jd", 2, "sql")], keys + ", status string, term string, priority string, source string, mentions int, resume_term string")
    titles = spark.createDataFrame([("p", "Analyst")], "posting_id string, title string")
    changes = spark.createDataFrame([("p", 1, i, "grammar", "a", "b") for i in range(70)], keys + ", change_no int, type string, from string, to string")
    N.write_report(N.build_report(scores, comps, finds, m, titles, changes), str(tmp_path / "r"))
    back = spark.read.json(str(tmp_path / "r")).first()
    assert len(back.change_log) == 70 and back.components[0].delta == 10 and back.posting_id == "p"


def test_nothing_is_cut(spark):
    """Long credentials, skills, keywords and lists are found whole."""
    from termloom.operators import entries as E
    from termloom.operators import lines as L

    docs = spark.createDataFrame([(1, "Certified in planning and inventory management since 2020"), (2, "one two three four five")], "doc_id long, text string")
    exp = M.expand_terms(spark.createDataFrame([("cpim",)], "term string"), dims.synonym_dim(spark), dims.credential_dim(spark))
    variants = exp.select(F.col("variant").alias("term"))
    ev = M.evidence(exp, M.term_hits(docs, variants), M.term_hits_unordered(docs, variants, dims.STOP_WORDS)).collect()
    assert [(r.doc_id, r.term, r.status) for r in ev] == [(1, "cpim", "SYNONYM")]
    five = spark.createDataFrame([("one two three four five",)], "term string")
    assert M.term_hits(docs, five).count() == 1
    long = "x" * 100
    lines = L.annotate_lines(spark.createDataFrame([("d", 0, long + ", sql")], "doc_id string, line_no int, text string"))
    assert [r.item for r in E.split_skills(lines).collect()] == [long, "sql"]
    kw = readers.keyword_table(spark.createDataFrame([(1, long)], "k int, raw string"), "k", "raw")
    assert kw.first().keyword == long
    c = spark.createDataFrame([("p", f"term{i:03d}", 1, 100 + i, False, False, False) for i in range(120)],
                              "posting_id string, term string, cnt int, weight_c int, required boolean, preferred boolean, tool boolean")
    assert P.prioritize_terms(P.weigh_terms(c), P.PostingConfig()).count() == 120


def test_any_order_rule_holds_for_every_key(spark):
    docs = spark.createDataFrame([(1, "a", "planning of stock"), (1, "b", "stock")], "doc_id int, part string, text string")
    terms = spark.createDataFrame([("stock planning",)], "term string")
    assert [(r.doc_id, r.part) for r in M.term_hits_unordered(docs, terms, dims.STOP_WORDS, ["doc_id", "part"]).collect()] == [(1, "a")]


def test_one_line_copied_very_often(spark):
    b = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("bullet_no"), F.lit("the quick brown fox jumps over the dog").alias("text"))
    b = b.union(spark.createDataFrame([(1, 100_001, "the quick brown fox jumped over the dog")], "doc_id int, bullet_no long, text string"))
    kept = V.near_dup_bullets(b).filter("not dropped").collect()
    assert [r.bullet_no for r in kept] == [100_001]


@pytest.mark.parametrize("raw,want", [("my my team", "Team."), ("I and our own plan", "And own plan."), ("A apple and an plan", "An apple and a plan."), ("ran it on a daily basis", "Ran it daily.")])
def test_clean_bullets(spark, raw, want):
    assert R.clean_bullets(spark.createDataFrame([(1, raw)], "bullet_no int, text string")).first().clean == want


@pytest.mark.parametrize("raw,want", [("ßend it", "ẞend it."), ("ﬁnd it", "ﬁnd it."), ("ŉ it", "ŉ it."), ("école", "École.")])
def test_first_letter_stays_one_character(spark, raw, want):
    assert R.clean_bullets(spark.createDataFrame([(1, raw)], "bullet_no int, text string")).first().clean == want


def test_name_case_character_by_character(spark):
    s = F.lit("İßa ΑΣ")
    assert one(spark, F.array(T.title_case(s), T.sentence_case(s), T.capitalize_first(F.lit("ßa")))) == ["IßA ασ", "ißa ΑΣ", "ẞa"]
