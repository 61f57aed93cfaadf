"""Postings to bucketed lines and weighted, prioritised terms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom import dims
from termloom import fixed_values as fv
from termloom.functions import terms as K
from termloom.functions import text as T
from termloom.operators.windows import sticky_mode, top_k
from termloom.session import write_once

GAP = "\x01"
Phrases = Sequence[str] | dict[str, str] | DataFrame  # phrases, phrase to label, or a table (phrase, label)


@dataclass(frozen=True)
class PostingConfig:
    """Dictionaries and limits of the posting analysis; every field may be replaced. A limit of None cuts nothing."""

    stop_words: Sequence[str] = tuple(dims.STOP_WORDS)
    banned: Sequence[str] = tuple(dims.BANNED_TERMS)
    filler: Sequence[str] = tuple(dims.PHRASE_FILLER)
    ad_words: Sequence[str] = tuple(dims.AD_WORDS)
    cues: dict = field(default_factory=lambda: dims.CUES)
    synonyms: dict = field(default_factory=lambda: dims.SYNONYMS)
    credentials: dict = field(default_factory=lambda: dims.CREDENTIALS)
    soft_skills: Sequence[str] = tuple(dims.SOFT_SKILLS)
    tech: Sequence[str] = tuple(dims.TECH_WORDS)
    qualification: Sequence[str] = tuple(dims.QUALIFICATION_WORDS)
    domain: Sequence[str] = tuple(dims.DOMAIN_WORDS)
    soft_words: Sequence[str] = tuple(dims.SOFT_WORDS)
    high_c: int = fv.HIGH_SCORE_C
    medium_c: int = fv.MEDIUM_SCORE_C
    cap: int | None = None  # terms per posting
    clause_grams: int | None = None  # most frequent grams of a clause its term is chosen from
    title_grams: int | None = None  # grams taken from a long title
    max_chars: int | None = None
    max_words: int | None = None


# --------------------------------------------------------------------- lines
def bucket_lines(postings: DataFrame, cues: dict, key: str = "posting_id", text: str = "text") -> DataFrame:
    """Posting lines with their bucket; a cue line sets the mode later bullets inherit."""
    lines = postings.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw"))
    lines = lines.select(key, "line_no", T.collapse_ws("raw").alias("text")).filter("text <> ''")
    cue = F.when(T.any_word("text", cues.get("noise", [])), "noise")
    for name in ("required", "preferred", "responsibilities", "qualifications", "tools"):
        if cues.get(name):
            cue = cue.when(T.any_word("text", cues[name]), name)
    lines = lines.withColumn("cue", cue)
    lines = sticky_mode(lines, key, "line_no", F.when(F.col("cue") != "noise", F.col("cue")), "mode")
    is_bullet = F.col("text").rlike(r"^[\x{2022}*-]") | F.col("text").rlike(r"^\(?\d{1,2}[.)]\s")
    bucket = F.coalesce("cue", F.when(is_bullet, F.coalesce("mode", F.lit("general"))), F.lit("general"))
    return lines.withColumn("bucket", bucket).drop("cue", "mode")


def bucket_counts(posting_lines: DataFrame, key: str = "posting_id") -> DataFrame:
    return posting_lines.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))


def posting_excerpts(posting_lines: DataFrame, limits: dict[str, int], key: str = "posting_id") -> DataFrame:
    """First k lines of the named buckets."""
    k = F.lit(None).cast("int")
    for b, n in limits.items():
        k = F.when(F.col("bucket") == b, F.lit(n)).otherwise(k)
    kept = posting_lines.filter(F.col("bucket").isin(list(limits)))
    ranked = top_k(kept, [key, "bucket"], [F.col("line_no")], max(limits.values()), "rank")
    return ranked.filter(F.col("rank") <= k)


def posting_title(text: Column | str) -> Column:
    """``title: X``, else the first capitalised line; a trailing place or work model is cut."""
    t = T.col(text)
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, f"^{fv.WS}+|{fv.WS}+$", ""))
    first = F.get(F.filter(lines, lambda x: x.rlike(fv.TITLE_LINE)), F.lit(0))
    raw = F.coalesce(F.nullif(F.regexp_extract(t, fv.TITLE_NAMED, 1), F.lit("")), first, F.lit(""))
    head = F.get(F.split(raw, r"\s+[-\x{2013}\x{2014}|]\s+|\s*[-(]"), F.lit(0))
    return F.trim(F.regexp_replace(T.collapse_ws(head), "[.,;]$", ""))


# --------------------------------------------------------------------- grams
def _gram_words(c: Column, stop_words: Sequence[str]) -> Column:
    """Words with stop words replaced by a gap mark; a gram with a gap in it is no candidate."""
    clean = F.regexp_replace(F.lower(T.collapse_ws(c)), r"[^a-z0-9+#/\s-]", " ")
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.isin(list(stop_words)), F.lit(GAP)).otherwise(w))


def _candidate_grams(c: Column, stop_words: Sequence[str], banned: Sequence[str], max_n: int) -> Column:
    grams = T.let(_gram_words(c, stop_words), lambda words: T.grams_of(words, max_n))
    return F.filter(grams, lambda g: ~g.contains(GAP) & g.rlike("^[^ ]{2,}") & ~g.isin(list(banned)))


def top_grams(c: Column, stop_words: Sequence[str], banned: Sequence[str], max_n: int, limit: int | None = None) -> Column:
    """Array of STRUCT<neg_count, neg_len, pos, term> of one short text, most frequent and longest first.

    For clauses and titles; whole documents go through ``ngrams``.
    """
    def score(all_: Column) -> Column:
        return F.transform(F.array_distinct(all_), lambda g, i: F.struct(
            (-F.size(F.filter(all_, lambda x: x == g))).alias("neg_count"), (-F.length(g)).alias("neg_len"), i.alias("pos"), g.alias("term")))

    ranked = F.array_sort(T.let(_candidate_grams(c, stop_words, banned, max_n), score))
    return ranked if limit is None else F.slice(ranked, 1, limit)


def _ranked_grams(grams: Column, limit: int | None) -> Column:
    """Distinct grams of an array as STRUCT<neg_cnt, neg_len, term>, in the order of ``ngrams``: equal ones stand together once sorted."""
    def runs(g: Column) -> Column:
        starts = F.filter(F.transform(g, lambda x, i: F.when((i == 0) | (x != F.get(g, i - 1)), i)), lambda i: i.isNotNull())
        return T.let(starts, lambda s: F.transform(s, lambda i, n: F.struct(
            (i - F.coalesce(F.get(s, n + 1), F.size(g))).alias("neg_cnt"), (-F.length(F.get(g, i))).alias("neg_len"), F.get(g, i).alias("term"))))

    ranked = F.sort_array(T.let(F.sort_array(grams), runs))
    return ranked if limit is None else F.slice(ranked, 1, limit)


def ngrams(df: DataFrame, key: str, text: str, stop_words: Sequence[str], banned: Sequence[str] = (), max_n: int = 4,
           limit: int | None = None) -> DataFrame:
    """Top grams per key by count, length, then term.

    A key that one row has is counted and ranked inside that row, so no gram is shuffled. Only texts that share a
    key are counted across rows; which keys those are is found first, from the keys alone.
    """
    repeated = write_once(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_key")), "repeated_keys")
    same = F.col(key).eqNullSafe(F.col("_key"))
    cand = _candidate_grams(F.col(text), stop_words, banned, max_n)
    one = df.join(repeated, same, "left_anti").select(key, F.posexplode(_ranked_grams(cand, limit)).alias("_i", "_g")).select(
        key, F.col("_g.term").alias("term"), (-F.col("_g.neg_cnt")).cast("long").alias("cnt"), (F.col("_i") + 1).alias("rank"))
    many = df.join(repeated, same, "left_semi").select(key, F.explode(cand).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("cnt"))
    return one.unionByName(top_k(many, [key], [F.desc("cnt"), F.desc(F.length("term")), F.col("term")], limit, "rank"))


def line_parts(c: Column) -> Column:
    """Clauses of a posting line: function words, commas, semicolons and spaced slashes separate."""
    s = F.regexp_replace(c, r"^[\s\x{2022}*\d.)\]-]+", "")
    s = F.regexp_replace(s, r"\s{2,}", " ; ")
    s = F.regexp_replace(s, " ", "  ")
    s = F.regexp_replace(s, rf"(?i)(^|[^a-z0-9_])({'|'.join(fv.GAP_WORDS)})([^a-z0-9_]|$)", "$1;$3")
    s = F.regexp_replace(T.collapse_ws(s), "[.;:]+$", "")
    parts = F.transform(F.split(s, r"\s*[,;]\s*|\s+/\s+"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def line_candidates(posting_lines: DataFrame, cfg: PostingConfig, key: str = "posting_id") -> DataFrame:
    """One term per clause: the longest of its (most frequent) grams.  No shuffle: all inside the row."""
    def best(part: Column) -> Column:
        top = top_grams(part, cfg.stop_words, cfg.banned, 3, cfg.clause_grams)
        return F.array_min(F.transform(top, lambda g, i: F.struct(g["neg_len"], g["neg_count"], i.alias("i"), g["term"])))

    rows = posting_lines.select(key, "line_no", "bucket", F.posexplode(line_parts(F.col("text"))).alias("part_no", "part"))
    rows = rows.withColumn("b", best(F.col("part"))).filter("b is not null")
    return rows.select(key, "line_no", "bucket", "part_no", F.col("b.term").alias("term"), (-F.col("b.neg_count")).alias("cnt"))


# --------------------------------------------------------------------- filters
def trim_filler(term: Column | str, filler: Sequence[str]) -> Column:
    """Filler words off both ends; one word always stays."""
    alt = "|".join(T.quote(w) for w in filler)
    t = F.regexp_replace(T.col(term), f"^(?:(?:{alt}) )+", "")
    return F.regexp_replace(t, f"(?: (?:{alt}))+$", "")


def is_noise(term: Column | str, cfg: PostingConfig) -> Column:
    return T.let(T.col(term), lambda t: _noise_test(t, cfg))


def _noise_test(t: Column, cfg: PostingConfig) -> Column:
    words = F.split(t, " ")
    return (
        (F.length(t) < 2) | (F.length(t) > cfg.max_chars if cfg.max_chars else F.lit(False))
        | t.isin(list(cfg.banned)) | t.isin(list(cfg.stop_words)) | t.isin(list(cfg.filler))
        | t.contains(" - ") | t.startswith("-") | t.endswith("-")
        | (F.size(words) > cfg.max_words if cfg.max_words else F.lit(False))
        | (t.contains(" ") & t.rlike("[0-9]"))
        | F.forall(words, lambda w: w.isin(list(cfg.ad_words)))
    )


def title_words(titles: DataFrame, key: str = "posting_id") -> DataFrame:
    """Single words of titles with three or more words: they are no terms of their own."""
    words = F.split(T.normalize_keyword("title"), " ")
    return titles.filter(F.size(words) > 2).select(key, F.explode(F.array_distinct(words)).alias("term"))


# --------------------------------------------------------------------- dictionaries
def padded(c: Column | str) -> Column:
    """Text as `` word word `` so that a whole-phrase test is one substring test."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(T.col(c)), "[^a-z0-9+#/&-]+", " ")), F.lit(" "))


def phrase_table(spark: SparkSession, phrases: Phrases) -> DataFrame:
    """(phrase, label) of a dictionary: a short list or mapping inline, or a table of any size as it is."""
    if isinstance(phrases, DataFrame):
        return phrases.select("phrase", "label").distinct()
    pairs = phrases.items() if isinstance(phrases, dict) else [(p, p) for p in phrases]
    return dims.small_table(spark, list(pairs), "phrase string, label string").distinct()


def phrase_mentions(rows: DataFrame, phrases: Phrases, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Distinct (keys, label) of the phrases that stand in the text as whole words.

    Grams of the lengths that occur in the dictionary meet it by equality, so its size is no part of the plan:
    Spark broadcasts it while it is small and shuffles grams by phrase beyond that.  A null text mentions nothing.
    """
    table = phrase_table(rows.sparkSession, phrases)
    lengths = sorted(r["n"] for r in table.select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect()) or [1]
    words = F.filter(F.split(F.trim(padded(text)), " "), lambda w: w != "")
    grams = T.let(words, lambda ws: F.array_distinct(T.grams_of(ws, max(lengths), lengths)))
    return rows.select(*keys, F.explode(grams).alias("phrase")).join(table, "phrase").select(*keys, "label").distinct()


def cert_mentions(postings: DataFrame, credentials: Phrases, key: str = "posting_id") -> DataFrame:
    """Known credentials by acronym (reported by full name), and ``XYZ certified``; each once per key."""
    explicit = F.transform(
        F.regexp_extract_all(F.col("text"), F.lit(r"(?:^|[^A-Za-z0-9_])([A-Z]{2,6}\s+(?:certification|certified))"), 1), F.lower)
    known = phrase_mentions(postings, credentials, [key]).withColumnRenamed("label", "term")
    named = postings.filter(F.col("text").contains("certifi"))  # the expression only reads texts that can hold it
    return known.unionByName(named.select(key, F.explode(explicit).alias("term"))).distinct()


def soft_skill_mentions(posting_lines: DataFrame, soft: Phrases, key: str = "posting_id") -> DataFrame:
    return phrase_mentions(posting_lines, soft, [key]).withColumnRenamed("label", "term")


def industry_mentions(posting_lines: DataFrame, industries: Phrases, key: str = "posting_id") -> DataFrame:
    kept = posting_lines.filter(F.col("bucket").isin("required", "responsibilities", "qualifications", "general"))
    hits = phrase_mentions(kept, industries, [key])
    return hits.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("industries"))


def action_verbs(posting_lines: DataFrame, verbs: Sequence[str], key: str = "posting_id") -> DataFrame:
    kept = posting_lines.filter(F.col("bucket").isin("responsibilities", "required", "preferred", "general"))
    words = F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", " ")), r"\s+")
    hits = kept.select(key, F.explode(F.filter(words, lambda w: w.isin(list(verbs)))).alias("verb"))
    return hits.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("verb")), ",").alias("verbs"))


def years_required(postings: DataFrame, key: str = "posting_id", text: str = "text") -> DataFrame:
    """Distinct (years, context) per posting; ranges give their lower bound; 1..45 only."""
    plain = [F.transform(F.regexp_extract_all(F.col(text), F.lit(p), 1), lambda y: F.struct(y.alias("y"), F.lit("").alias("c")))
             for p in (fv.YEARS_PATTERNS[0], fv.YEARS_PATTERNS[1])]
    rng = fv.YEARS_PATTERNS[2].replace(r"\d{1,2}\s*years", r"(\d{1,2})\s*years")
    low = F.zip_with(
        F.regexp_extract_all(F.col(text), F.lit(rng), 1), F.regexp_extract_all(F.col(text), F.lit(rng), 2),
        lambda a, b: F.struct(F.least(a.cast("int"), b.cast("int")).cast("string").alias("y"), F.lit("").alias("c")))
    ctx = fv.YEARS_PATTERNS[3].replace("[a-z ]{3,40}", "([a-z ]{3,40})")
    named = F.zip_with(
        F.regexp_extract_all(F.col(text), F.lit(ctx), 1), F.regexp_extract_all(F.col(text), F.lit(ctx), 2),
        lambda a, b: F.struct(a.alias("y"), F.lower(F.trim(b)).alias("c")))
    some = postings.filter(F.lower(F.col(text)).contains("year"))  # in every pattern: the others are not read by them
    return (
        some.select(key, F.explode(F.concat(*plain, low, named)).alias("h"))
        .select(key, F.col("h.y").cast("int").alias("years"), F.col("h.c").alias("context"))
        .filter(F.col("years").between(1, 45))
        .distinct()
    )


# --------------------------------------------------------------------- terms
def has_synonym(term: Column, synonyms: dict) -> Column:
    keys = list(synonyms)
    return term.isin(keys) | F.regexp_replace(term, "s$", "").isin(keys)


def term_candidates(postings: DataFrame, cfg: PostingConfig, user_keywords: DataFrame | None = None) -> DataFrame:
    """Every source of terms in one table with its weight (hundredths) and flags."""
    lines = bucket_lines(postings, cfg.cues)
    flag = lambda b: F.lit(b)
    bucket = F.col("bucket")
    weight = F.lit(0)
    for b, wc in fv.BUCKET_WEIGHT_C.items():
        weight = F.when(bucket == b, F.lit(wc)).otherwise(weight)
    from_lines = line_candidates(lines.filter(bucket != "noise"), cfg).select(
        "posting_id", "term", "cnt", weight.alias("weight_c"), (bucket == "required").alias("required"),
        (bucket == "preferred").alias("preferred"), (bucket == "tools").alias("tool"))
    titles = postings.select("posting_id", posting_title("text").alias("title")).filter("title <> ''")
    words = F.size(F.split(T.normalize_keyword("title"), " "))
    short = F.array(F.struct(F.lit(-1).alias("neg_count"), F.lit(0).alias("neg_len"), F.lit(0).alias("pos"), T.normalize_keyword("title").alias("term")))
    from_titles = titles.select("posting_id", F.explode(F.when(words <= 4, short).otherwise(
        top_grams(F.col("title"), cfg.stop_words, cfg.banned, 3, cfg.title_grams))).alias("g")).select(
        "posting_id", F.col("g.term").alias("term"), (-F.col("g.neg_count")).alias("cnt"), F.lit(fv.TITLE_WEIGHT_C).alias("weight_c"),
        flag(False).alias("required"), flag(False).alias("preferred"), flag(False).alias("tool"))
    const = lambda df, wc, req, pref: df.select(
        "posting_id", "term", F.lit(1).alias("cnt"), F.lit(wc).alias("weight_c"), flag(req).alias("required"),
        flag(pref).alias("preferred"), flag(False).alias("tool"))
    out = from_lines.unionByName(from_titles)
    out = out.unionByName(const(cert_mentions(postings, cfg.credentials), fv.CERT_WEIGHT_C, True, False))
    out = out.unionByName(const(soft_skill_mentions(lines, cfg.soft_skills), fv.SOFT_WEIGHT_C, False, True))
    if user_keywords is not None:
        out = out.unionByName(const(user_keywords.select("posting_id", F.col("keyword").alias("term")), fv.USER_WEIGHT_C, True, False))
    clean = out.withColumn("term", trim_filler(T.normalize_keyword("term"), cfg.filler)).filter(~is_noise("term", cfg))
    return clean.join(title_words(titles), ["posting_id", "term"], "left_anti")


def weigh_terms(candidates: DataFrame) -> DataFrame:
    """Sum counts and weights and OR the flags per (posting, term)."""
    return candidates.groupBy("posting_id", "term").agg(
        F.sum("cnt").alias("cnt"), F.sum("weight_c").alias("weight_c"), F.bool_or("required").alias("required"),
        F.bool_or("preferred").alias("preferred"), F.bool_or("tool").alias("tool"))


def prioritize_terms(weighed: DataFrame, cfg: PostingConfig) -> DataFrame:
    """Score, priority and the top ``cap`` terms per posting."""
    syn = has_synonym(F.col("term"), cfg.synonyms)
    df = weighed.withColumn("category", K.categorize(
        "term", cfg.soft_skills, syn, cfg.tech, cfg.qualification, cfg.domain, cfg.soft_words))
    bonus = F.when(syn, F.lit(fv.SYNONYM_BONUS_C)).otherwise(0) + F.when(
        F.col("category").isin("technology", "domain-skill", "qualification"), F.lit(fv.CATEGORY_BONUS_C)).otherwise(0)
    df = df.withColumn("score_c", F.col("weight_c") + F.col("cnt") * fv.COUNT_WEIGHT_C + bonus)
    df = df.withColumn("priority", F.when(F.col("score_c") >= cfg.high_c, "HIGH").when(
        F.col("score_c") >= cfg.medium_c, "MEDIUM").otherwise("LOW"))
    return top_k(df, ["posting_id"], [F.desc("score_c"), F.col("term")], cfg.cap, "rank")


def posting_terms(postings: DataFrame, cfg: PostingConfig, user_keywords: DataFrame | None = None) -> DataFrame:
    return prioritize_terms(weigh_terms(term_candidates(postings, cfg, user_keywords)), cfg)


VIEWS = {
    "hard": lambda: F.col("required"),
    "required": lambda: F.col("required") & (F.col("category") != "soft-skill"),
    "preferred": lambda: F.col("preferred") | ((F.col("priority") == "MEDIUM") & ~F.col("required")),
    "tools": lambda: F.col("tool") | (F.col("category") == "technology"),
    "technologies": lambda: F.col("category").isin("technology", "domain-skill"),
    "domain": lambda: F.col("category").isin("domain", "domain-skill"),
}


def term_view(terms: DataFrame, name: str) -> DataFrame:
    return terms.filter(VIEWS[name]())
