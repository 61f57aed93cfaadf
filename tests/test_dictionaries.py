"""Dictionary joins, fragments of promoted terms, and probes of repetitive bullets."""

import random

import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import postings as P
from termloom.operators import rewrite as R
from termloom.operators import versions as V


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_phrases_by_list_mapping_and_table(spark):
    lines = spark.createDataFrame(
        [(1, "Stock planning, and C++ / r&d work."), (1, "stock planning"), (2, "stockplanning"), (3, None), (4, ""), (5, "Planning stock; (planning)")],
        "posting_id int, text string")
    soft = ["planning", "stock planning", "c++", "r&d", "missing", ""]
    want = [(1, "c++"), (1, "planning"), (1, "r&d"), (1, "stock planning"), (5, "planning"), (5, "stock planning")]
    assert rows_of(P.soft_skill_mentions(lines, soft)) == want
    table = spark.createDataFrame([(p, p) for p in soft] + [("planning", "planning")], "phrase string, label string")
    assert rows_of(P.soft_skill_mentions(lines, table)) == want
    certs = P.cert_mentions(lines.union(spark.createDataFrame([(6, "CPIM certified, cpa")], "posting_id int, text string")), {"cpa": "accountant", "c++": "plus"})
    assert rows_of(certs) == [(1, "plus"), (6, "accountant"), (6, "cpim certified")]
    none = lines.filter("posting_id > 100")
    assert rows_of(P.soft_skill_mentions(none, soft)) == [] and rows_of(P.soft_skill_mentions(lines, [])) == []
    kept = lines.withColumn("bucket", F.when(F.col("posting_id") == 5, "noise").otherwise("general"))
    assert rows_of(P.industry_mentions(kept, ["stock planning", "planning"])) == [(1, "planning,stock planning")]


def test_a_dictionary_of_a_hundred_thousand_phrases(spark):
    """The dictionary is a table of the join and no literal of the plan."""
    table = spark.range(100_000).select(F.concat(F.lit("phrase number "), "id").alias("phrase"), F.concat(F.lit("L"), "id").alias("label"))
    lines = spark.createDataFrame([(1, "Phrase number 7 and phrase number 99999"), (2, "phrase number 100000")], "posting_id int, text string")
    hits = P.phrase_mentions(lines, table, ["posting_id"])
    assert rows_of(hits) == [(1, "L7"), (1, "L99999")]
    assert len(hits._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_promotion_and_its_reasons(spark):
    terms = ["java", "sql", "analyst", "script", "go", "rust"]
    keys = "posting_id int, doc_id int"
    m = spark.createDataFrame([(7, 1, t, "MATCHED", True, "HIGH", "jd") for t in terms] + [(7, 2, "java", "MATCHED", True, "HIGH", "jd"), (7, 1, "cobol", "MISSING", True, "HIGH", "jd")],
                              keys + ", term string, status string, can_insert boolean, priority string, source string")
    hits = spark.createDataFrame([(1, t) for t in terms if t != "rust"] + [(2, "java")], "doc_id int, term string")
    skills = spark.createDataFrame([(1, "SQL ")], "doc_id int, item string")
    roles = spark.createDataFrame([(1, "Analyst")], "doc_id int, role string")
    bodies = spark.createDataFrame([(1, ["javascript", "go", "sqlite", "", "analyst", "gone", "java"]), (2, ["java"]), (3, None)], "doc_id int, tokens array<string>")
    got = {(r.doc_id, r.term): r.reason for r in R.promote_skills(m, hits, skills, roles, bodies).collect()}
    part = "part of a longer term"
    assert got == {(1, "java"): part, (1, "script"): part, (1, "go"): part, (1, "analyst"): "a job title", (1, "rust"): "not in the body", (2, "java"): ""}


def test_token_ends_against_every_end(spark):
    rnd = random.Random(3)
    word = lambda least, most: "".join(rnd.choice("ab") for _ in range(rnd.randint(least, most)))
    rows = [(i, [word(0, 6) for _ in range(8)], sorted({word(2, 4) for _ in range(8)})) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, tokens array<string>, terms array<string>")
    got = {r.k: sorted(r.e) for r in df.select("k", R.token_ends("tokens", "terms").alias("e")).collect()}
    assert got == {k: [w for w in terms if any(len(w) < len(t) and (t.startswith(w) or t.endswith(w)) for t in tokens)] for k, tokens, terms in rows}


def distance(a, c):
    prev = list(range(len(c) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(c, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def dropped(texts, threshold):
    """Every pair, by definition."""
    out = set()
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            a, b = x.strip().lower(), y.strip().lower()
            if i == j or (len(y), -j) <= (len(x), -i):
                continue
            near = len(a) > 10 and len(b) > 10 and min(len(a), len(b)) > max(len(a), len(b)) * threshold and 1 - distance(a, b) / max(len(a), len(b)) > threshold
            if near or (x == y and x.strip()):
                out.add(i)
    return out


@pytest.mark.parametrize("threshold", [0.9, 0.8, 0.6])
def test_repetitive_near_duplicates_against_every_pair(spark, threshold):
    """Texts of few distinct grams find all partners without meeting every text."""
    rnd = random.Random(11)
    texts = []
    for _ in range(14):
        unit = "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 3))).strip() or "a"
        base = (unit * 30)[:rnd.randint(9, 34)].strip()
        texts.append(base)
        for _ in range(3):
            chars = list(base)
            for _ in range(rnd.randint(1, 4)):
                at = rnd.randrange(len(chars))
                kind = rnd.randrange(3)
                if kind == 0:
                    chars[at] = rnd.choice("abc")
                elif kind == 1:
                    chars.insert(at, rnd.choice("abc"))
                elif len(chars) > 2:
                    del chars[at]
            texts.append("".join(chars).strip())
    b = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, bullet_no int, text string")
    got = {r.bullet_no for r in V.near_dup_bullets(b, threshold=threshold).filter("dropped").collect()}
    assert got == dropped(texts, threshold)


def test_gram_length_needs_enough_grams():
    assert V._gram_length(0.9) == V.GRAM and V._gram_length(0.55) == 1
    with pytest.raises(ValueError):
        V._gram_length(0.5)


def test_one_document_of_very_many_repetitive_lines(spark):
    """100,000 different lines with the same long beginning: their common grams are frequent and not probed."""
    n = 100_000
    tail = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40)
    b = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("bullet_no"), F.concat(F.lit("ha ha ha ha ha ha ha "), tail).alias("text"))
    near = b.filter("bullet_no < 5").select("doc_id", (F.col("bullet_no") + n).alias("bullet_no"), F.concat(F.col("text"), F.lit("x")).alias("text"))
    got = sorted(r.bullet_no for r in V.near_dup_bullets(b.union(near)).filter("dropped").collect())
    assert got == [0, 1, 2, 3, 4]


def test_near_duplicates_of_empty_and_null_texts(spark):
    schema = "doc_id int, bullet_no int, text string, tok string"
    b = spark.createDataFrame([(1, 1, None, "t"), (1, 2, "", "t"), (1, 3, "   ", "t"), (None, 4, "the same line twice", "t"), (1, 5, "the same line twice", None), (1, 6, "the same line twice", None)], schema)
    got = {r.bullet_no: r.dropped for r in V.near_dup_bullets(b).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: False, 6: True}
    assert V.near_dup_bullets(b.filter("doc_id = 9")).count() == 0


def test_gain_by_surroundings_against_whole_texts(spark):
    """Every swap held against every pool term in the whole texts, before and after."""
    rnd = random.Random(5)
    words = ["stock", "stocks", "plan", "planning", "plans", "it's", "'s", "s", "The", "of", "box", "boxes", "Big", "x's's", "  ", "\n", "a-b", "parties", "party", ",", "ΣΣ"]
    text = lambda n: rnd.choice([" ", "", " "]).join(rnd.choice(words) for _ in range(n)) if rnd.random() < 0.2 else " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 14))) for i in range(150)] + [(150, None), (151, ""), (152, "plan")]
    swaps = [("plan", "planning"), ("stock", "box"), ("it's", "its"), ("the", "big plan"), ("planning", "plan of"), ("box", ""), ("a-b", "party"), (None, "x"), ("big", None)]
    cand = [(p, d, s, t) for p in ("p", "q") for d, _ in docs for s, t in swaps if rnd.random() < 0.7]
    pool = [("p", t) for t in ["stock planning", "plan", "stock", "big plan", "of the", "lan o", "box", "party", "s s", ""]] + [("q", "planning stock"), ("q", "x"), ("q", "boxes of stock")]
    docs = spark.createDataFrame(docs, "doc_id int, text string")
    cand = spark.createDataFrame(cand, "posting_id string, doc_id int, source string, target string")
    pool = spark.createDataFrame(pool, "posting_id string, term string")
    got = rows_of(R.substitution_gain(docs, cand, pool, ["of"]).select("posting_id", "doc_id", "source", "target", "gain"))
    j = cand.join(docs, "doc_id").withColumn("_after", R._swap_first(F.col("text"), F.col("source"), F.col("target"))).join(pool, "posting_id")
    hit = lambda c: T.mentioned_in(T.soft_normalize(c), F.col("term"), ["of"]).cast("int")
    plain = j.groupBy("posting_id", "doc_id", "source", "target").agg(F.sum(hit("_after") - hit("text")).alias("gain")).filter("gain > 0")
    want = rows_of(plain.select("posting_id", "doc_id", "source", "target", "gain"))
    assert got == want and len(want) > 40


def test_gain_asks_the_text_only_for_terms_a_swap_may_change(spark):
    docs = spark.createDataFrame([(1, "purchasing of parts " + "and much other text " * 5000)], "doc_id int, text string")
    swaps = spark.createDataFrame([(1, "purchasing", "procurement")], "doc_id int, source string, target string")
    near = R.swap_surroundings(docs, swaps, 12).first()
    assert near.near_before.startswith("purchasing of parts") and len(near.near_before) < 40 and near.words_before[0] == "purchasing"
    assert near.near_after.startswith("procurement of parts") and near.words_after[0] == "procurement"
