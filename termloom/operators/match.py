"""Joining posting terms to documents.

The expensive question, which document mentions which term, is answered once
per (document, distinct term) and every later job joins that table by equality.
No join here is hinted: Spark broadcasts a side only while its own size check
allows it and shuffles beyond, with skewed partitions split at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom import fixed_values as fv
from termloom.functions import text as T
from termloom.session import write_once

PRIORITY_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}


# --------------------------------------------------------------------- targets
def target_pool(terms: DataFrame, user_keywords: DataFrame | None = None, roles: DataFrame | None = None) -> DataFrame:
    """Posting terms by priority, then user keywords, then the target role; the first source wins."""
    rank = F.lit(3)
    for p, r in PRIORITY_RANK.items():
        rank = F.when(F.col("priority") == p, F.lit(r)).otherwise(rank)
    pool = terms.select("posting_id", F.col("term").alias("display"), F.lit("jd").alias("source"), "priority", rank.alias("src_rank"),
                        F.col("rank").cast("int").alias("pos"))
    if user_keywords is not None:
        pool = pool.unionByName(user_keywords.select(
            "posting_id", F.col("keyword").alias("display"), F.lit("user").alias("source"), F.lit("HIGH").alias("priority"),
            F.lit(4).alias("src_rank"), F.col("pos").cast("int").alias("pos")))
    if roles is not None:
        pool = pool.unionByName(roles.select(
            "posting_id", F.col("role").alias("display"), F.lit("target-role").alias("source"), F.lit("HIGH").alias("priority"),
            F.lit(5).alias("src_rank"), F.lit(0).alias("pos")))
    best = pool.withColumn("term", T.normalize_keyword("display")).filter("term <> ''").groupBy("posting_id", "term").agg(
        F.min_by(F.struct("display", "source", "priority"), F.struct("src_rank", "pos")).alias("b"))
    return best.select("posting_id", "term", "b.display", "b.source", "b.priority")


def expand_terms(terms: DataFrame, synonyms: DataFrame, credentials: DataFrame) -> DataFrame:
    """(term, variant, ord): the term, its synonyms, its head noun's synonyms, its credential twin."""
    base = terms.select("term").distinct()
    syn = synonyms.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("ord", F.lower("synonym").alias("synonym")))).alias("syns"))
    words = F.split("term", " ")
    head = F.when(F.size(words) > 1, F.element_at(words, -1))
    df = base.withColumn("_one", F.regexp_replace("term", "s$", "")).withColumn("_head", head).withColumn(
        "_head_one", F.regexp_replace("_head", "s$", "")).withColumn("_cred", F.regexp_replace("term", fv.CREDENTIAL_SUFFIX, ""))
    for k, name in (("term", "_s0"), ("_one", "_s1"), ("_head", "_h0"), ("_head_one", "_h1")):
        df = df.join(syn.select(F.col("term").alias(k if k != "term" else "_t"), F.col("syns").alias(name)),
                     (F.col("_t") == df["term"]) if k == "term" else k, "left")
        df = df.drop("_t")
    both = credentials.select(F.lower("acronym").alias("_c"), F.lower("full_name").alias("twin")).unionByName(
        credentials.select(F.lower("full_name").alias("_c"), F.lower("acronym").alias("twin")))
    both = both.groupBy("_c").agg(F.min("twin").alias("twin"))
    df = df.join(both.withColumnRenamed("twin", "_tw0"), F.col("_c") == F.col("term"), "left").drop("_c")
    df = df.join(both.withColumnRenamed("twin", "_tw1"), F.col("_c") == F.col("_cred"), "left").drop("_c")
    none = F.array().cast("array<struct<ord:int,synonym:string>>")
    shift = lambda a, by: F.transform(F.coalesce(*a, none), lambda s: F.struct((s["ord"] + by).alias("ord"), s["synonym"].alias("variant")))
    twin = F.coalesce("_tw0", "_tw1")
    allv = F.concat(
        F.array(F.struct(F.lit(0).alias("ord"), F.col("term").alias("variant"))),
        shift(["_s0", "_s1"], 100), shift(["_h0", "_h1"], 10_000),
        F.when(twin.isNotNull(), F.array(F.struct(F.lit(1_000_000).alias("ord"), twin.alias("variant")))).otherwise(
            F.array().cast("array<struct<ord:int,variant:string>>")))
    out = df.select("term", F.explode(allv).alias("v")).groupBy("term", F.col("v.variant").alias("variant")).agg(F.min("v.ord").alias("ord"))
    return out


# --------------------------------------------------------------------- hits
def term_forms(terms: DataFrame, word_mode: bool = True) -> DataFrame:
    """(term, form, literal): the term and, as further rows, its singular and plural."""
    k = T.term_key if word_mode else (lambda c: T.col(c))
    rows = terms.select("term", F.explode(F.array(
        F.struct(F.lit(True).alias("literal"), F.col("term").alias("f")),
        F.struct(F.lit(False).alias("literal"), T.singularize("term").alias("f")),
        F.struct(F.lit(False).alias("literal"), T.pluralize("term").alias("f")))).alias("x"))
    rows = rows.select("term", "x.literal", k("x.f").alias("form")).filter("form <> ''")
    return rows.groupBy("term", "form").agg(F.max("literal").alias("literal"))


def _count_hits(per_form: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Literal mentions; the other forms count only where the literal is absent."""
    lit, other = F.sum(F.when(F.col("literal"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("literal"), F.lit(0)).otherwise(F.col("n")))
    return per_form.groupBy(*keys, "term").agg(F.when(lit > 0, lit).otherwise(other).cast("int").alias("mentions"))


def term_hits(docs: DataFrame, terms: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(doc, term, mentions) by whole words: word grams joined to term forms by equality.

    From each word on, a text yields as many words as the longest form has, so no form is too long to be found.
    They meet the forms by their first word, and by their first two, and the form has to lead them: work follows the
    words of the text, not the lengths of the forms. A column ``pieces`` (``marked_pieces``) of ``docs`` is used, if it
    is there, here and in ``term_hits_unordered``.

    Words leave the scan unaggregated and meet the forms first, so only hits are
    shuffled by (doc, term) while the term table is broadcastable; beyond that
    the join shuffles by leading words and adaptive execution splits hot ones.
    """
    forms = term_forms(terms).withColumn("lead", F.substring_index("form", " ", 2))
    most = max(form_lengths(forms))
    tails = T.with_marks(docs, text).select(*keys, F.explode(T.marked_tails("pieces", most)).alias("tail"))
    one, two = F.substring_index("tail", " ", 1), F.substring_index("tail", " ", 2)
    leads = tails.select(*keys, "tail", F.explode(F.when(F.col("tail").contains(" "), F.array(one, two)).otherwise(F.array(one))).alias("lead"))
    hits = leads.join(forms, "lead").filter(F.concat("tail", F.lit(" ")).startswith(F.concat("form", F.lit(" "))))
    return _count_hits(hits.withColumn("n", F.lit(1)), keys)


def form_lengths(forms: DataFrame) -> list[int]:
    """Lengths of the forms in words: a few numbers, read once to size the tails."""
    return sorted(r["n"] for r in forms.select(F.size(F.split("form", " ")).alias("n")).distinct().collect()) or [1]


def _short_grams(word: Column, most: int) -> Column:
    """Distinct runs of 1..most characters of a word."""
    chars = F.split(word, "")
    runs = [chars]
    for n in range(2, most + 1):
        rest = F.slice(chars, n, F.greatest(F.size(chars) - (n - 1), F.lit(0)))
        runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), F.size(rest)), rest, lambda x, y: F.concat(x, y)))
    return F.array_distinct(F.concat(*runs))


def term_hits_substring(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same table with literal substring semantics, JVM-side and by equi-joins.

    A text holds a needle only if one of its tokens holds the needle's longest
    piece between spaces.  Pieces therefore meet the distinct tokens of the
    corpus, by their first three characters, and tokens lead to the documents.
    A needle without a space is counted from the tokens; one with spaces is
    counted in the texts of its candidates, each text joined once.
    """
    forms = write_once(term_forms(terms, word_mode=False), "needles")
    hay = docs.select(key, T.soft_normalize(text).alias("hay"))
    pieces = F.filter(F.split("form", " "), lambda p: p != "")
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("piece"))))["piece"]
    needles = forms.select("form").distinct().withColumn("piece", longest).filter("piece is not null")
    tokens = write_once(hay.select(key, F.explode(F.split("hay", " ")).alias("token")).filter("token <> ''").groupBy(key, "token").agg(
        F.count(F.lit(1)).alias("n")), "tokens")
    starts = needles.select("piece").distinct().withColumn("gram", F.substring("piece", 1, 3))
    words = tokens.select("token").distinct().select("token", F.explode(_short_grams(F.col("token"), 3)).alias("gram"))
    inside = words.join(starts, "gram").filter(F.expr("contains(token, piece)")).select("token", "piece")
    seen = tokens.join(write_once(inside, "inside"), "token")
    found = seen.join(needles.filter("not contains(form, ' ')"), "piece").groupBy(key, "form").agg(
        F.sum(F.col("n") * T.count_occurrences("token", "form")).alias("n"))
    spaced = seen.join(needles.filter("contains(form, ' ')"), "piece").select(key, "form").distinct()
    lists = spaced.groupBy(key).agg(F.collect_list("form").alias("forms"))  # at most the needles per document
    in_text = hay.join(lists, key).select(key, F.explode(F.transform("forms", lambda f: F.struct(
        f.alias("form"), T.count_occurrences(F.col("hay"), f).alias("n")))).alias("x")).select(key, "x.form", "x.n").filter("n > 0")
    return _count_hits(found.unionByName(in_text).join(forms, "form"), [key])


def term_hits_unordered(docs: DataFrame, terms: DataFrame, stop_words: Sequence[str], keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(doc, term) where every significant word of a multi-word term occurs, in any order.

    The texts are read once, down to the (doc, word) pairs the terms can use.
    Candidates then come from the rarest word of each term only, so a frequent
    word does not pair its documents with all terms that contain it, and the
    other words are semi-joined.
    """
    toks = F.array_distinct(F.filter(F.split("term", " "), lambda t: (F.length(t) > 1) & ~t.isin(list(stop_words))))
    multi = terms.select("term").distinct().withColumn("toks", toks).filter(F.size("toks") > 1)
    wanted = multi.select("term", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    forms = wanted.select("tok").distinct().select(
        "tok", F.explode(F.array_distinct(F.array("tok", T.singularize("tok")))).alias("word"))
    words = T.with_marks(docs, text).select(*keys, F.explode(F.array_distinct(F.flatten(T.pieces_of("pieces")))).alias("word"))
    seen = write_once(words.join(forms, "word").select(*keys, "tok").distinct(), "token_hits")
    freq = seen.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    anchor = wanted.join(freq, "tok").groupBy("term").agg(F.min_by("tok", F.struct("df", "tok")).alias("tok"))
    cand = seen.join(anchor, "tok").select(*keys, "term", F.col("tok").alias("anchor"))
    others = cand.join(wanted, "term").filter("tok <> anchor").join(seen, [*keys, "tok"], "left_semi")
    return others.groupBy(*keys, "term", "n").agg(F.count(F.lit(1)).alias("k")).filter("k = n - 1").select(*keys, "term")


# --------------------------------------------------------------------- evidence
def evidence(expanded: DataFrame, hits: DataFrame, unordered: DataFrame | None = None, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(doc, term, status, mentions, resume_term): literal hit, else the first variant that hits.

    ``hits`` is keyed by variant.  A hit that only holds in any order counts as
    a synonym hit of that variant with no literal mention.
    """
    keys = list(keys)
    all_hits = hits.select(*keys, F.col("term").alias("variant"), "mentions")
    if unordered is not None:
        all_hits = all_hits.unionByName(unordered.select(*keys, F.col("term").alias("variant"), F.lit(0).alias("mentions")))
        all_hits = all_hits.groupBy(*keys, "variant").agg(F.max("mentions").alias("mentions"))
    j = all_hits.join(expanded, "variant")
    literal = F.max(F.when(F.col("ord") == 0, F.col("mentions")))
    agg = j.groupBy(*keys, "term").agg(
        F.coalesce(literal, F.lit(0)).alias("_lit"), F.min_by(F.struct("variant", "mentions"), F.col("ord")).alias("_first"))
    hit = F.col("_lit") > 0
    return agg.select(
        *keys, "term", F.when(hit, "MATCHED").otherwise("SYNONYM").alias("status"),
        F.when(hit, F.col("_lit")).otherwise(F.col("_first.mentions")).cast("int").alias("mentions"),
        F.when(hit, F.col("term")).otherwise(F.col("_first.variant")).alias("resume_term"))


def candidate_pairs(pool: DataFrame, ev: DataFrame) -> DataFrame:
    """(posting, doc) pairs that share at least one term."""
    return pool.select("posting_id", "term").join(ev.select("doc_id", "term"), "term").select("posting_id", "doc_id").distinct()


def match_status(pool: DataFrame, ev: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per (posting, doc, term) of the given pairs with MATCHED / SYNONYM / MISSING."""
    return (
        pairs.join(pool, "posting_id")
        .join(ev, ["doc_id", "term"], "left")
        .withColumn("status", F.coalesce("status", F.lit("MISSING")))
        .withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    )


def missing_terms(pool: DataFrame, ev: DataFrame, pairs: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Wanted terms without any evidence."""
    out = pairs.join(pool, "posting_id").join(ev.select("doc_id", "term"), ["doc_id", "term"], "left_anti")
    if categories is not None:
        out = out.join(categories.select("posting_id", "term", "category"), ["posting_id", "term"], "left")
        out = out.withColumn("category", F.coalesce("category", F.lit("other")))
    return out


def evidenced(pool: DataFrame, ev: DataFrame) -> DataFrame:
    """The rows of ``match_status`` that are not MISSING, over all pairs, without building pairs.

    Dealt by document, so what is then counted per (posting, doc) stays in its task: only the evidence is shuffled.
    """
    return ev.repartition("doc_id").join(pool, "term")


def summary_of(pool: DataFrame, hits: DataFrame) -> DataFrame:
    """``match_summary`` of all pairs that share a term, from the evidenced rows and the size of each pool."""
    sizes = pool.groupBy("posting_id").agg(F.count(F.lit(1)).alias("targets"))
    per = hits.groupBy("posting_id", "doc_id").agg(
        F.count(F.lit(1)).alias("matched"), F.count_if(F.col("status") == "MATCHED").alias("literal"),
        F.count_if(F.col("status") == "SYNONYM").alias("via_synonym"),
        F.count_if((F.col("status") == "SYNONYM") & F.col("can_insert")).alias("insertable"))
    return per.join(sizes, "posting_id").select(
        "posting_id", "doc_id", "targets", "matched", "literal", "via_synonym", (F.col("targets") - F.col("matched")).alias("missing"),
        T.pct(F.col("matched"), F.col("targets")).alias("coverage"), "insertable")


def missing_lists(pool: DataFrame, ev: DataFrame, wanted: DataFrame, order: Sequence[str]) -> DataFrame:
    """(posting, doc, missing): rows of ``wanted`` (posting, term and others) without evidence, sorted by ``order``, per pair that shares a term of the pool.

    A pair carries the terms it has; what the posting wants is joined by posting, so no (pair, term) row is shuffled.
    """
    held = evidenced(pool.select("posting_id", "term"), ev.select("doc_id", "term")).groupBy("posting_id", "doc_id").agg(F.collect_set("term").alias("_held"))
    rest = [c for c in wanted.columns if c != "posting_id" and c not in order]
    want = wanted.groupBy("posting_id").agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("_want"))
    return held.join(want, "posting_id").select(
        "posting_id", "doc_id", F.filter("_want", lambda w: ~F.array_contains("_held", w["term"])).alias("missing"))


def evidence_docs(docs: DataFrame, ev: DataFrame, terms: DataFrame) -> DataFrame:
    """Documents that evidence at least one of the terms."""
    return docs.join(ev.join(terms.select("term"), "term", "left_semi"), "doc_id", "left_semi")


def match_locations(section_evidence: DataFrame) -> DataFrame:
    """Where a term was seen: summary / skills / experience."""
    at = lambda s: F.bool_or(F.col("section_id") == s).alias(f"in_{s}")
    return section_evidence.groupBy("doc_id", "term").agg(at("summary"), at("skills"), at("experience"))


def can_substitute(pairs: DataFrame, allow: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Adds allowed: same term, an allow-listed direction, or the target lists the source as synonym."""
    src, tgt = T.normalize_keyword("source"), T.normalize_keyword("target")
    rules = allow.select(F.lower("source").alias("_src"), F.lower("target").alias("_tgt")).unionByName(
        synonyms.select(F.lower("synonym").alias("_src"), F.lower("term").alias("_tgt"))).distinct().withColumn("_ok", F.lit(True))
    df = pairs.withColumn("_src", src).withColumn("_tgt", tgt).join(rules, ["_src", "_tgt"], "left")
    same = (F.col("_src") == F.col("_tgt")) & (F.col("_src") != "")
    return df.withColumn("allowed", same | F.coalesce("_ok", F.lit(False))).drop("_src", "_tgt", "_ok")


def with_insertable(matches: DataFrame, allow: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Adds can_insert: the document's wording may be rewritten to the term. Decided once per distinct pair of words."""
    pairs = matches.filter("status <> 'MISSING'").select(F.col("resume_term").alias("source"), F.col("term").alias("target")).distinct()
    ok = can_substitute(pairs, allow, synonyms).filter("allowed").select(F.col("source").alias("resume_term"), F.col("target").alias("term"), F.lit(True).alias("_i"))
    return matches.join(ok, ["resume_term", "term"], "left").withColumn("can_insert", F.coalesce("_i", F.lit(False))).drop("_i")


def match_summary(matches: DataFrame) -> DataFrame:
    """Counts per pair; ``insertable`` counts synonym hits that may be rewritten to the term."""
    n = F.count(F.lit(1))
    hit = F.count_if(F.col("status") != "MISSING")
    return matches.groupBy("posting_id", "doc_id").agg(
        n.alias("targets"), hit.alias("matched"), F.count_if(F.col("status") == "MATCHED").alias("literal"),
        F.count_if(F.col("status") == "SYNONYM").alias("via_synonym"), (n - hit).alias("missing"), T.pct(hit, n).alias("coverage"),
        F.count_if((F.col("status") == "SYNONYM") & F.col("can_insert")).alias("insertable"))


def repeated_terms(matched: DataFrame, moderate: int = 3, high: int = 6) -> DataFrame:
    r = matched.filter((F.col("status") == "MATCHED") & (F.col("mentions") >= moderate))
    return r.withColumn("level", F.when(F.col("mentions") >= high, "high").otherwise("moderate"))


def term_demand(pool: DataFrame, ev: DataFrame, n_docs: Column | int) -> DataFrame:
    """Per term: postings that want it, documents that show it, documents that lack it.

    Counted on both sides separately, so no (posting, doc) pair is built.
    """
    want = pool.groupBy("term").agg(F.countDistinct("posting_id").alias("n_postings"))
    have = ev.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))
    total = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return want.join(have, "term", "left").select(
        "term", "n_postings", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), (total - F.coalesce("n_docs", F.lit(0))).alias("n_missing"))
