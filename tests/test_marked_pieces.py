"""Words cut at marks are the words of ``word_pieces``, and the jobs read the texts once."""

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import match as M
from termloom.operators import scores as S

TEXTS = ["", None, " ", "A. b.\u0085", "C++ / C# & .NET -- e-mail./x ./- -. --", "Node.js's tools.  Next\u2003line\n\n/and/ R&D, a.b. ", "İstanbul ΣΑΣ straße’s é x.y... z", "a - b -/- c\r\nd . e", "...", "1.5 .5 5. -5- &a& \u00a0."]


def test_pieces_are_those_of_word_pieces(spark):
    df = T.with_marks(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    full = lambda c: F.filter(c, lambda p: F.size(p) > 0)
    for r in df.select("doc_id", full(T.word_pieces("text")).alias("a"), full(T.pieces_of("pieces")).alias("b"), T.word_grams("text", 3, [3]).alias("c"), T.marked_tails("pieces", 3).alias("d")).collect():
        assert r.a == r.b and r.c == (r.d and [t for t in r.d if t.count(" ") == 2]), TEXTS[r.doc_id]


def test_jobs_need_no_text_beside_the_pieces(spark):
    docs = T.with_marks(spark.createDataFrame([(1, "Planning of budgets. Data, planning")], "doc_id long, text string")).select("doc_id", "pieces")
    terms = spark.createDataFrame([("planning of budget",), ("data planning",)], "term string")
    assert [(r.term, r.mentions) for r in M.term_hits(docs, terms).collect()] == [("planning of budget", 1)]
    assert {r.term for r in M.term_hits_unordered(docs, terms, ["of"]).collect()} == {"data planning"}
    duties = spark.createDataFrame([(7, "planning", 2), (7, "other", 1)], "posting_id long, word string, n long")
    assert [tuple(r) for r in S.duty_hits(duties, docs).collect()] == [(7, 1, 2)]


def test_forms_that_share_leading_words(spark):
    docs = spark.createDataFrame([(1, "big data set big data. big data sets, big dat a big"), (2, None), (3, "set")], "doc_id long, text string")
    terms = spark.createDataFrame([("big",), ("big data",), ("big data set",), ("data set big data",), ("set big data big data",)], "term string")
    got = {(r.doc_id, r.term): r.mentions for r in M.term_hits(docs, terms).collect()}
    assert got == {(1, "big"): 5, (1, "big data"): 3, (1, "big data set"): 1, (1, "data set big data"): 1}
    assert [(r.doc_id, r.mentions) for r in M.term_hits(docs, terms.filter("term = 'big'")).collect()] == [(1, 5)]
