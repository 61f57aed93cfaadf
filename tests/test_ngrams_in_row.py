"""Top grams are counted inside the row of a text; only texts that share a key meet."""

import io
from contextlib import redirect_stdout

from termloom.operators import postings as P

TEXTS = [(1, "red cat red cat blue cat"), (2, ""), (3, None), (4, "of"), (5, "red cat"), (5, "red cat blue cat"), (None, "red cat"), (None, "cat")]


def rows(df, key):
    return [(r.term, r.cnt, r["rank"]) for r in sorted(df.filter(f"doc_id <=> {key}").collect(), key=lambda r: r["rank"])]


def test_ranks(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    g = P.ngrams(df, "doc_id", "text", ["of"], ["blue"], 2)
    assert rows(g, 1) == [("cat", 3, 1), ("red cat", 2, 2), ("red", 2, 3), ("blue cat", 1, 4), ("cat blue", 1, 5), ("cat red", 1, 6)]
    assert rows(g, 5) == [("cat", 3, 1), ("red cat", 2, 2), ("red", 2, 3), ("blue cat", 1, 4), ("cat blue", 1, 5)]
    assert rows(g, "null") == [("cat", 2, 1), ("red cat", 1, 2), ("red", 1, 3)]
    assert {r.doc_id for r in g.collect()} == {1, 5, None}
    assert [len(rows(P.ngrams(df, "doc_id", "text", ["of"], ["blue"], 2, 2), k)) for k in (1, 5, "null")] == [2, 2, 2]


def test_texts_with_a_key_of_their_own_shuffle_no_gram(spark):
    df = spark.range(50).selectExpr("id as doc_id", "concat('word', id % 3, ' of great length') as text")
    out = io.StringIO()
    g = P.ngrams(df, "doc_id", "text", ["of"], [], 3, 40)
    g.collect()
    with redirect_stdout(out):
        g.explain()
    one = out.getvalue().split("Union")[1]
    assert one.index("LeftAnti") < one.index("LeftSemi") and "hashpartitioning" not in one[: one.index("LeftSemi")].split("HashAggregate")[0]
