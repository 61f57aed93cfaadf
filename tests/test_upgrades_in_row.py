"""Upgraded bullets and their advice come out of one row: nothing is shuffled, and no regular expression reads a text without its phrase."""

import io
from contextlib import redirect_stdout

from termloom.operators import rewrite as R

TEXTS = [(1, "Responsible for the depot"), (2, "Handled returns, LOOKED AFTER stock"), (3, "helped with audits"), (4, None), (5, "unhandled"), (6, "İ Handled ΣΑΣ"), (7, "Tasked with x; tasked with y")]


def test_upgrades_and_advice(spark):
    rows = {r.bullet_no: r for r in R.upgraded_bullets(spark.createDataFrame(TEXTS, "bullet_no int, text string")).collect()}
    assert {k: r.upgraded for k, r in rows.items()} == {
        1: "Managed the depot", 2: "Handled returns, LOOKED AFTER stock", 3: "supported audits", 4: None, 5: "unhandled", 6: "İ Handled ΣΑΣ", 7: "Executed x; executed y"}
    assert {k: r.advice for k, r in rows.items() if r.advice} == {2: "handled; looked after", 6: "handled"}


def test_a_phrase_made_by_an_earlier_step_is_seen(spark):
    openers = [("did", "took Part", "do"), ("took part", "made", "do")]
    got = R.upgraded_bullets(spark.createDataFrame([(1, "we did it")], "bullet_no int, text string"), openers, {"took part": "do", "made": "do"}).collect()
    assert got[0].upgraded == "we made it"


def test_query_has_no_shuffle(spark):
    from termloom.plans import registry

    out = io.StringIO()
    with redirect_stdout(out):
        registry.all_queries()["upgrade_verbs"](spark, "/root/testdata/sf0.001").explain()
    assert "Exchange" not in out.getvalue() and "Join" not in out.getvalue()
