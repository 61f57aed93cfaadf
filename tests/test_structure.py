"""Hand-written layouts: sections, entries and bullets."""

import pytest
from pyspark.sql import functions as F

from termloom import dims
from termloom.operators import entries as E
from termloom.operators import lines as L

SIZE = {"h": 13.0, "sub": 10.5, "role": 11.5}
A = "Led the move of 30 reports to one metric store, cutting cost by 20%."
B = "Built batch jobs that load 2 TB of click data each day."
C = "Rewrote the session model in SQL, lifting accuracy by 12%."

# (kind, text); expected jobs: (role, company, year in dates, bullets)
LAYOUTS = {
    "two-line": ([("h", "EXPERIENCE"), ("role", "Lead Data Engineer"), ("meta", "Orbit Metrics | Pune, India | 2021 - Present"), ("b", A), ("b", B)],
                 [("Lead Data Engineer", "Orbit Metrics", "2021", 2)]),
    "one-line": ([("h", "WORK EXPERIENCE"), ("role", "Data Engineer | Southgate Stores | Pune, India | 2018 - 2021"), ("b", C), ("b", A)],
                 [("Data Engineer", "Southgate Stores", "2018", 2)]),
    "dates-own-line": ([("h", "EXPERIENCE"), ("role", "Analytics Engineer"), ("meta", "Nickel Retail Labs, Hyderabad"), ("dates", "Jan 2021 – Present"), ("b", B)],
                       [("Analytics Engineer", "Nickel Retail Labs", "2021", 1)]),
    "wrapped": ([("h", "EXPERIENCE"), ("role", "Lead Data Engineer"), ("meta", "Orbit Metrics | 2021 - Present"),
                 ("b", "Rebuilt the intake service so that 2019-era jobs and the new path"), ("cont", "share one contract, which removed 3 hours of manual work."), ("b", B),
                 ("cont", "Daily, with retries wired into the scheduler.")],
                [("Lead Data Engineer", "Orbit Metrics", "2021", 2)]),
    "promotion": ([("h", "EXPERIENCE"), ("role", "Senior Data Engineer"), ("meta", "Apex Corp | Delhi | 2021 - Present"), ("b", A),
                   ("role", "Data Engineer"), ("meta", "Apex Corp | Delhi | 2018 - 2021"), ("b", C)],
                  [("Senior Data Engineer", "Apex Corp", "2021", 1), ("Data Engineer", "Apex Corp", "2018", 1)]),
    "projects-after": ([("h", "EXPERIENCE"), ("role", "Data Engineer"), ("meta", "Southgate Stores | 2018 - 2021"), ("b", C),
                        ("h", "PROJECTS"), ("role", "Shopper profile"), ("meta", "Open source | 2022"), ("b", "Unified 9 sources.")],
                       [("Data Engineer", "Southgate Stores", "2018", 1)]),
    "freelance": ([("h", "EXPERIENCE"), ("role", "Freelance Data Consultant"), ("b", B)], [("Freelance Data Consultant", "", "", 1)]),
    "sub-heading": ([("h", "PROFESSIONAL EXPERIENCE"), ("sub", "EARLY CAREER"), ("role", "Data Analyst Intern"), ("meta", "Peak Retail | 2015 - 2016"), ("b", B),
                     ("sub", "ADDITIONAL"), ("role", "Volunteer Data Coach"), ("b", A)],
                    [("Data Analyst Intern", "Peak Retail", "2015", 1), ("Volunteer Data Coach", "", "", 1)]),
    "company-first": ([("h", "EXPERIENCE"), ("meta", "Orbit Metrics"), ("role", "Lead Data Engineer, Bengaluru"), ("dates", "Jan 2019 – Present"), ("b", A)],
                      [("Lead Data Engineer", "Orbit Metrics", "2019", 1)]),
    "no-glyphs": ([("h", "EXPERIENCE"), ("role", "Data Engineer"), ("meta", "Southgate Stores | 2018 - 2021"), ("plain", A), ("plain", B), ("plain", C)],
                  [("Data Engineer", "Southgate Stores", "2018", 3)]),
    "child-heading": ([("h", "PROFESSIONAL EXPERIENCE"), ("role", "Lead Data Engineer"), ("meta", "Orbit Metrics | 2021 - Present"), ("b", A),
                       ("h", "RELEVANT EXPERIENCE"), ("role", "Data Engineer"), ("meta", "Southgate Stores | 2018 - 2021"), ("b", C)],
                      [("Lead Data Engineer", "Orbit Metrics", "2021", 1), ("Data Engineer", "Southgate Stores", "2018", 1)]),
    "three-jobs": ([("h", "EXPERIENCE"), ("role", "Lead Data Engineer"), ("meta", "Orbit Metrics | Pune, India | 2021 - Present"), ("b", A), ("cont", "and kept all of it running"), ("b", B),
                    ("role", "Data Engineer"), ("meta", "Southgate Stores | Pune, India"), ("dates", "2018 - 2021"), ("b", C),
                    ("role", "Analytics Engineer | Nickel Retail Labs"), ("dates", "2016 – 2018"), ("b", A)],
                   [("Lead Data Engineer", "Orbit Metrics", "2021", 2), ("Data Engineer", "Southgate Stores", "2018", 1), ("Analytics Engineer", "Nickel Retail Labs", "2016", 1)]),
}


@pytest.fixture(scope="module")
def segmented(spark):
    rows = []
    for lid, (doc, _) in LAYOUTS.items():
        doc = [("name", "Asha Rao"), ("contact", "Pune, India | +91 90000 11111 | asha@example.org"), ("h", "PROFESSIONAL SUMMARY"), ("plain", "Data engineer."), *doc,
               ("h", "EDUCATION"), ("plain", "B.Tech, Computing - State University, 2016")]
        for i, (k, t) in enumerate(doc):
            rows.append((lid, i, t, k == "b", SIZE.get(k, 9.5), k in ("h", "sub", "role"), 2 if k == "h" else 3 if k == "sub" else 0))
    lines = L.annotate_lines(spark.createDataFrame(
        rows, "doc_id string, line_no int, text string, is_bullet boolean, font_size double, bold boolean, heading_level int"))
    return L.segment_sections(lines, dims.alias_dim(spark), dims.WEAK_HEADINGS).cache()


@pytest.fixture(scope="module")
def jobs(segmented):
    body = segmented.filter("section_id = 'experience' and in_body")
    bounded = E.entry_boundaries(body)
    return bounded, E.settle_entry(bounded), E.entry_bullets(bounded)


def test_layout_jobs(jobs):
    _, settled, bullets = jobs
    n = {(r.doc_id, r.section_no, r.entry_no): r["n"] for r in bullets.groupBy("doc_id", "section_no", "entry_no").agg(F.count("*").alias("n")).collect()}
    got = {}
    for r in settled.orderBy("doc_id", "section_no", "entry_no").collect():
        got.setdefault(r.doc_id, []).append((r.role, r.company, r.dates, n.get((r.doc_id, r.section_no, r.entry_no), 0)))
    for lid, (_, want) in LAYOUTS.items():
        have = got.get(lid, [])
        assert len(have) == len(want), (lid, have)
        for (role, company, year, k), (grole, gcompany, gdates, gk) in zip(want, have):
            assert (role, company, k) == (grole, gcompany, gk), (lid, have)
            assert (year in gdates) if year else gdates == "", (lid, have)


def test_wrapped_text_is_kept(jobs):
    _, _, bullets = jobs
    text = " ".join(r.text for r in bullets.filter("doc_id = 'wrapped'").collect())
    assert "share one contract" in text and "Daily, with retries" in text


def test_foreign_sections_stay_out(jobs):
    bounded, _, _ = jobs
    assert bounded.filter(F.col("text").contains("Shopper profile") | F.col("text").contains("Unified 9")).count() == 0


def test_skills_certs_languages_education(spark):
    mk = lambda *ts: L.annotate_lines(spark.createDataFrame([("d", i, t) for i, t in enumerate(ts)], "doc_id string, line_no int, text string"))
    s = E.split_skills(mk("Systems: SAP S/4HANA, Excel / Power BI", "CI/CD; SQL")).orderBy("group_no", "item_no").collect()
    assert [(r.label, r.item) for r in s] == [("Systems", "SAP S/4HANA"), ("Systems", "Excel"), ("Systems", "Power BI"), ("", "CI/CD"), ("", "SQL")]
    c = E.split_certs(mk("Certified Planner (CP), 2021", "Green Belt 2020")).orderBy("item_no").collect()
    assert [(r.name, r.year) for r in c] == [("Certified Planner (CP)", "2021"), ("Green Belt 2020", "2020")]
    lang = E.split_languages(mk("English (fluent), German")).orderBy("item_no").collect()
    assert [(r.name, r.level) for r in lang] == [("English", "fluent"), ("German", "")]
    ed = E.parse_education(mk("BSc Trade | University of York | 2015 - 2019").withColumn("section_no", F.lit(1))).first()
    assert (ed.degree, ed.institution, ed.dates) == ("BSc Trade", "University of York", "2015 - 2019")


@pytest.mark.parametrize("raw,want", [("BSc Trade | University 1900 | 1996", ("BSc Trade", "University 1900", "1900")), ("BSc Trade | University 2026 | 06/1997", ("BSc Trade", "University 2026", "2026")),
                                      ("BSc Trade | University 1996 | 1996", ("BSc Trade", "University 1996", "1996")),
                                      ("BSc Trade | University of York 2015", ("BSc Trade", "University of York", "2015"))])
def test_year_in_the_name_of_a_school(spark, raw, want):
    lines = L.annotate_lines(spark.createDataFrame([("d", 0, raw)], "doc_id string, line_no int, text string"))
    ed = E.parse_education(lines.withColumn("section_no", F.lit(1))).first()
    assert (ed.degree, ed.institution, ed.dates) == want


def test_summary_goes_before_the_body(spark):
    p = spark.createDataFrame([("d", "skills", 1), ("d", "languages", 2)], "doc_id string, section_id string, position int")
    out = L.insert_summary(p, spark.createDataFrame([("d",)], "doc_id string")).orderBy("position").collect()
    assert [r.section_id for r in out] == ["summary", "skills", "languages"]
