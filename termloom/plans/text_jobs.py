"""Sources and scalar expressions over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions import terms as K
from termloom.functions import contacts as C
from termloom import fixed_values as fv
from termloom.plans import corpus as D
from termloom.plans.registry import query
from termloom.sources import readers as R

MENTION_TERMS = ["the", "thing", "onand", "tion", "the of", "les", "edition"]


def _long(name):
    return F.col(name).cast("long").alias(name)


@query
def read_docs(spark, sf):
    return D.documents(spark, sf).select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("text_len"))


@query
def triage_files(spark, sf):
    """Landed files made from the stored pages: a name, a length and the first bytes, of all the shapes that occur."""
    k = F.col("page_id")
    name = F.concat(F.lit("in/"), k, F.element_at(F.array(*[F.lit(e) for e in (".pdf", ".docx", ".PDF", ".txt", "")]), (k % 5 + 1).cast("int")))
    head = F.element_at(F.array(*[F.lit(h) for h in (fv.PDF_MAGIC_HEX, fv.ZIP_MAGIC_HEX, fv.OLE_MAGIC_HEX, "3C21")]), (k % 4 + 1).cast("int"))
    body = F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, head).otherwise(F.concat(head, F.hex("html")))
    files = D.table(spark, sf, "pages").select(name.alias("path"), F.unhex(body).alias("content"))
    return R.triage_files(files.withColumn("length", F.octet_length("content").cast("long"))).select("path", "ext", _long("length"), "code")


@query
def triage_postings(spark, sf):
    docs = D.documents(spark, sf).select("text").withColumn("kind", F.lit("document"))
    posts = D.postings(spark, sf).select("text").withColumn("kind", F.lit("posting"))
    return R.triage_text(docs.unionByName(posts)).groupBy("kind", "code").agg(F.count(F.lit(1)).alias("n"))


@query
def flag_no_text(spark, sf):
    return R.flag_no_text(D.documents(spark, sf)).filter("no_text").select("doc_id", "source")


@query
def html_blocks(spark, sf):
    b = R.html_blocks(D.table(spark, sf, "pages"))
    return b.select("page_id", _long("block_no"), "kind", _long("heading_level"), "text")


@query
def read_keywords(spark, sf):
    k = R.keyword_table(D.documents(spark, sf), "doc_id", "text")
    return k.select("doc_id", "keyword", _long("pos"))


@query
def normalize_text(spark, sf):
    return D.documents(spark, sf).select("doc_id", T.normalize_text("text").alias("norm"))


@query
def soft_normalize(spark, sf):
    return D.table(spark, sf, "conversations").select(
        "conv_id", "turn", T.collapse_ws("text").alias("collapsed"), T.soft_normalize("text").alias("soft"))


def _vocabulary(spark, sf):
    words = D.documents(spark, sf).select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word"))
    return words.filter("word <> ''").distinct()


@query
def singularize(spark, sf):
    return _vocabulary(spark, sf).select("word", T.singularize("word").alias("singular"), T.pluralize("word").alias("plural"))


@query
def count_words(spark, sf):
    return D.documents(spark, sf).select(
        "doc_id", T.count_words("text").cast("long").alias("n_words"),
        T.count_occurrences("text", F.lit("The")).cast("long").alias("n_the"))


def _mention_pairs(spark, sf):
    terms = F.array(*[F.lit(t) for t in MENTION_TERMS])
    # normalise each text once, before it meets the terms
    docs = D.documents(spark, sf).select("doc_id", T.soft_normalize("text").alias("hay"))
    return docs.select("doc_id", "hay", F.explode(terms).alias("term"))


@query
def count_mentions(spark, sf):
    return _mention_pairs(spark, sf).select("doc_id", "term", T.mentions_in(F.col("hay"), T.normalize_keyword("term")).cast("long").alias("mentions"))


@query
def text_mentions(spark, sf):
    return _mention_pairs(spark, sf).select("doc_id", "term", T.mentioned_in(F.col("hay"), T.normalize_keyword("term"), D.STOPS).alias("mentioned"))


@query
def similarity(spark, sf):
    from pyspark.sql import Window

    lines = D.document_lines(spark, sf)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumn("prev", F.lag("text").over(w)).filter("prev is not null").select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.round(T.similarity("prev", "text"), 6).alias("sim"))


@query
def clamp_pct(spark, sf):
    li = D.table(spark, sf, "lineitem").select(T.clamp_pct(F.col("l_extendedprice") / 400.0 - 20.25).cast("long").alias("value"))
    return li.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query
def bullet_prefix(spark, sf):
    b = D.document_lines(spark, sf).filter("is_bullet")
    return b.select("doc_id", _long("line_no"), "marker", "bullet_text", "numbered")


@query
def extract_date(spark, sf):
    d = D.dated_lines(spark, sf).select("o_orderkey", T.extract_date("line").alias("dates"), T.is_current("line").alias("is_current"))
    lines = D.document_lines(spark, sf).select(F.col("doc_id").alias("o_orderkey"), T.extract_date("text").alias("dates"),
                                               T.is_current("text").alias("is_current")).filter("dates <> ''")
    return d.unionByName(lines)


@query
def is_current_flag(spark, sf):
    d = D.dated_lines(spark, sf)
    return d.groupBy(T.is_current("dates").alias("is_current")).agg(F.count(F.lit(1)).alias("n"))


@query
def normalize_dates(spark, sf):
    return D.dated_lines(spark, sf).select("o_orderkey", T.normalize_dates("dates").alias("dates"))


@query
def has_metric(spark, sf):
    return D.document_lines(spark, sf).filter(T.has_metric("text")).select("doc_id", _long("line_no"))


@query
def starts_with_verb(spark, sf):
    return D.document_lines(spark, sf).filter(T.starts_with_verb("text", D.VERBS)).select("doc_id", _long("line_no"))


@query
def passive_flag(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", F.concat(F.element_at(
        F.array(*[F.lit(s) for s in ("Was Responsible for", "worked on", "unhelped", "owned")]),
        (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit(" "), F.col("o_orderpriority")).alias("text"))
    return o.select("o_orderkey", T.passive_flag("text").alias("passive"))


@query
def detect_tense(spark, sf):
    t = T.detect_tense("text", D.PAST_WORDS, D.PRESENT_STEMS)
    return D.document_lines(spark, sf).select("doc_id", _long("line_no"), t.alias("tense"))


@query
def extract_contacts(spark, sf):
    c = C.contacts(D.document_lines(spark, sf), D.WEAK_HEADINGS, D.PLACES)
    return c.select("doc_id", "name", "email", "phone", "linkedin", "portfolio", "location")


@query
def role_company_location_flags(spark, sf):
    lines = D.document_lines(spark, sf)
    return lines.select("doc_id", _long("line_no"), K.looks_like_role("text", D.ROLE_WORDS).alias("is_role"),
                        K.looks_like_company("text", D.COMPANY_WORDS).alias("is_company"),
                        K.looks_like_location("text", D.PLACES).alias("is_location"))


@query
def categorize_term(spark, sf):
    v = _vocabulary(spark, sf).select(F.col("word").alias("term"))
    return v.select("term", K.categorize("term", D.SOFT, list(D.SYNONYMS), D.TECH, D.QUAL, D.DOMAIN, D.SOFT_WORDS).alias("category"))


@query
def bullet_style(spark, sf):
    return D.documents(spark, sf).select("doc_id", T.bullet_style(
        F.translate("text", "$%#", "•▪●")).alias("style"))


@query
def name_case(spark, sf):
    return D.document_lines(spark, sf).select(
        "doc_id", _long("line_no"), T.title_case("text").alias("title"), T.sentence_case("text").alias("sentence"),
        T.end_with_period(T.capitalize_first("text")).alias("closed"))
