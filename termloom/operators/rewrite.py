"""Rule-based clean-up of bullets, skills and summaries, with a change log.

Rules are data (small lists) folded into nested column expressions, so all of
them run in one pass over the bullets.  Nothing is written that the source does
not support; what is held back is reported as advice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom import dims
from termloom import fixed_values as fv
from termloom.functions import text as T
from termloom.session import write_once


def clean_text(c: Column | str, rules: Sequence[tuple[str, str]] = tuple(dims.CLEANUP_RULES)) -> Column:
    out = T.col(c)
    for pattern, to in rules:
        out = F.regexp_replace(out, pattern, to)
    return T.end_with_period(T.capitalize_first(out))


def clean_bullets(bullets: DataFrame, rules: Sequence[tuple[str, str]] = tuple(dims.CLEANUP_RULES)) -> DataFrame:
    return bullets.withColumn("clean", clean_text("text", rules))


def upgraded_bullets(bullets: DataFrame, openers: Sequence[tuple[str, str, str]] = tuple(dims.WEAK_OPENERS),
                     levels: dict[str, str] | None = None) -> DataFrame:
    """Bullets with ``upgraded`` and ``advice``, both worked out in the row.

    A weak opener is replaced only by a verb on the same claim level; where the
    stronger verb would claim more, the bullet stays and ``advice`` names the opener (null where there is none).
    A regular expression only sees texts that hold its phrase; each step is a column of its own, so it is worked out once.
    """
    levels = levels or dims.CLAIM_LEVEL
    # ASCII letters have one lower case wherever they stand, so a text without the phrase cannot match
    holds = lambda c, phrase: F.lower(F.col(c)).contains(phrase.lower()) if phrase.isascii() else F.lit(True)
    rows, held = bullets.withColumn("upgraded", F.col("text")), []
    for phrase, verb, scope in openers:
        body = T.quote(phrase)
        any_case = f"(?i){fv.EDGE_L}{body}{fv.EDGE_R}"
        if levels.get(verb.lower()) != scope:
            held.append(F.when(holds("text", phrase) & F.col("text").rlike(any_case), F.lit(phrase)))
            continue
        upper = f"(^|[^A-Za-z0-9_])(?i:{body})([^A-Za-z0-9_]|$)"
        cap = f"(^|[^A-Za-z0-9_]){T.quote(phrase[0].upper() + phrase[1:])}([^A-Za-z0-9_]|$)"
        new = F.regexp_replace(F.regexp_replace("upgraded", cap, f"$1{verb}$2"), upper, f"$1{verb[0].lower() + verb[1:]}$2")
        rows = rows.withColumn("upgraded", F.when(holds("upgraded", phrase), new).otherwise(F.col("upgraded")))
    return rows.withColumn("advice", F.nullif(F.concat_ws("; ", *held), F.lit("")) if held else F.lit(None).cast("string"))


def upgrade_verbs(bullets: DataFrame, openers: Sequence[tuple[str, str, str]] = tuple(dims.WEAK_OPENERS),
                  levels: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(bullets with ``upgraded``, advice rows) of ``upgraded_bullets``."""
    rows = upgraded_bullets(bullets, openers, levels)
    return rows.drop("advice"), rows.filter("advice is not null").drop("upgraded")


def normalize_tense(bullets: DataFrame, verbs: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Leading verb to its past form, or to the present where ``is_current`` holds."""
    verbs = verbs or dims.VERBS
    word = F.regexp_extract("text", r"^([A-Za-z]+)", 1)
    pairs = {v: p for v, (p, _) in verbs.items()}
    past = F.create_map(*[F.lit(x) for v, p in pairs.items() for x in (v, p)])
    present = F.create_map(*[F.lit(x) for v, p in pairs.items() for x in (p.lower(), v[0].upper() + v[1:])])
    to = F.when(F.col("is_current"), present[F.lower(word)]).otherwise(past[F.lower(word)])
    rest = F.substring(F.col("text"), F.length(word) + 1, F.length("text"))
    return bullets.withColumn("tensed", F.when(to.isNotNull(), F.concat(to, rest)).otherwise(F.col("text")))


def _place(text: Column, source: Column) -> Column:
    """Position of the first whole-word occurrence of source, 0 if there is none."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]", " "), F.lit(" "))
    plain = F.regexp_replace(F.lower(source), "[^a-z0-9]", " ")
    # the pad shifts positions by one and the searched phrase carries its own blank: both cancel out
    return F.call_function("instr", padded, F.concat(F.lit(" "), plain, F.lit(" ")))


def _swap_first(text: Column, source: Column, target: Column) -> Column:
    """First whole-word occurrence of source replaced, capital kept."""
    at = _place(text, source)
    old = F.substring(text, at, F.length(source))
    new = F.when(old.rlike("^[A-Z]"), F.concat(F.upper(F.substring(target, 1, 1)), F.substring(target, F.lit(2), F.length(target)))).otherwise(target)
    swapped = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(source), F.length(text)))
    return F.when(at > 0, swapped).otherwise(text)


def align_terms(bullets: DataFrame, allowed: DataFrame, keys: Sequence[str] = ("doc_id",), on: str = "doc_id") -> DataFrame:
    """Allow-listed posting wording for the first whole-word occurrence of the source phrase.

    ``allowed``: (keys, source, target), a short list per key. With the default key each bullet comes back
    once; keyed by (posting, doc) a bullet comes back for each posting that has swaps for its document.
    """
    swaps = allowed.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("source", "target"))).alias("_swaps"))
    df = bullets.join(swaps, on, "left" if list(keys) == [on] else "inner")
    none = F.array().cast("array<struct<source:string,target:string>>")
    out = F.aggregate(F.coalesce("_swaps", none), F.col("text"), lambda acc, s: _swap_first(acc, s["source"], s["target"]))
    return df.withColumn("aligned", out).drop("_swaps")


def swap_surroundings(docs: DataFrame, swaps: DataFrame, reach: int) -> DataFrame:
    """(doc, source, target, near_before, near_after, words_before, words_after) of the swaps a document holds.

    ``near_*``: what the swap changes in the normalised text with ``reach`` characters on both sides; ``words_*``:
    the words it changes.  All else stands in both texts, so a phrase of at most ``reach`` characters, or a word,
    that is in both or in neither of them is as present after the swap as before.
    """
    j = swaps.join(docs.select("doc_id", "text"), "doc_id").withColumn("_at", _place(F.col("text"), F.col("source"))).filter("_at > 0")
    j = j.withColumns({"_b": T.soft_normalize("text"), "_a": T.soft_normalize(_swap_first(F.col("text"), F.col("source"), F.col("target")))})
    short = F.least(F.length("_b"), F.length("_a"))
    # both ends are kept as normalised by themselves, less a few characters that may depend on what follows; then compared
    kept = lambda c: F.least(F.greatest(F.length(T.soft_normalize(c)) - 4, F.lit(0)), short)
    j = j.withColumns({"_p": kept(F.substring("text", F.lit(1), F.col("_at") - 1)), "_s": kept(F.substring("text", F.col("_at") + F.length("source"), F.length("text")))})
    left = lambda c: F.substring(c, F.lit(1), F.col("_p"))
    right = lambda c: F.substring(c, F.length(c) - F.col("_s") + 1, F.col("_s"))
    j = j.withColumn("_p", F.when(left("_b") == left("_a"), F.col("_p")).otherwise(0))
    j = j.withColumn("_s", F.when((right("_b") == right("_a")) & (F.col("_p") + F.col("_s") <= short), F.col("_s")).otherwise(0))
    first = F.substring_index(left("_b"), " ", -1)
    last = F.substring_index(right("_b"), " ", 1)
    middle = lambda c: F.substring(c, F.col("_p") + 1, F.length(c) - F.col("_p") - F.col("_s"))
    start = F.greatest(F.col("_p") - reach, F.lit(0))
    near = lambda c: F.substring(c, start + 1, F.length(c) - F.greatest(F.col("_s") - reach, F.lit(0)) - start)
    words = lambda c: F.array_distinct(F.split(F.concat(first, middle(c), last), " "))
    return j.select("doc_id", "source", "target", near("_b").alias("near_before"), near("_a").alias("near_after"),
                    words("_b").alias("words_before"), words("_a").alias("words_after"))


def _may_change(term: Column) -> Column:
    """A form of the term, or one of its words, is on one side of the surroundings only."""
    phrase = lambda f: F.col("near_before").contains(f) != F.col("near_after").contains(f)
    word = lambda t: F.array_contains("words_before", t) != F.array_contains("words_after", t)
    return (phrase(term) | phrase(T.singularize(term)) | phrase(T.pluralize(term))
            | F.exists(F.split(term, " "), lambda t: word(t) | word(T.singularize(t))))


def substitution_gain(docs: DataFrame, candidates: DataFrame, pool: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """Per (posting, doc, swap): covered terms after minus before; only gains stay, the best first.

    Terms are first held against the surroundings of a swap; only those it may change are looked up in the text,
    which is read once for a swap of a document, however many postings and terms ask.  A null text, source or target gains nothing.
    """
    candidates = candidates.select("posting_id", "doc_id", "source", "target").distinct()
    pool = pool.select("posting_id", "term").distinct()
    reach = (pool.agg(F.max(F.length("term"))).first()[0] or 0) + 2  # a plural adds two characters
    swaps = candidates.select("doc_id", "source", "target").distinct()
    near = write_once(swap_surroundings(docs, swaps, reach), "surroundings")
    swap = ["doc_id", "source", "target"]
    asked = candidates.join(near, swap).join(pool, "posting_id").filter(_may_change(F.col("term"))).select("posting_id", *swap, "term")
    asked = write_once(asked, "asked")
    terms = asked.groupBy(*swap).agg(F.collect_set("term").alias("_terms")).join(docs.select("doc_id", "text"), "doc_id")
    terms = terms.withColumns({"_b": T.soft_normalize("text"), "_a": T.soft_normalize(_swap_first(F.col("text"), F.col("source"), F.col("target")))})
    hit = lambda c, t: T.mentioned_in(F.col(c), t, stop_words).cast("int")
    moved = F.transform("_terms", lambda t: F.struct(t.alias("term"), (hit("_a", t) - hit("_b", t)).alias("d")))
    moved = terms.select(*swap, F.explode(F.filter(moved, lambda m: m["d"] != 0)).alias("m")).select(*swap, "m.*")
    gain = asked.join(moved, [*swap, "term"]).groupBy("posting_id", *swap).agg(F.sum("d").alias("gain")).filter("gain > 0")
    w = Window.partitionBy("posting_id", "doc_id").orderBy(F.desc("gain"), "source", "target")
    return gain.withColumn("rank", F.row_number().over(w))


def drop_short(bullets: DataFrame) -> DataFrame:
    return bullets.filter((F.length(T.collapse_ws("text")) >= 8) & (T.count_words("text") >= 3))


def skills_by_demand(skills: DataFrame, matches: DataFrame, keys: Sequence[str] = ("posting_id", "doc_id")) -> DataFrame:
    """Skill items by matched rank, unknown 500, missing 999, then name."""
    rank = matches.select(*keys, F.col("term").alias("_t"), F.when(F.col("status") == "MISSING", F.lit(999)).otherwise(F.col("rank")).alias("_r"))
    df = skills.withColumn("_t", T.normalize_keyword("item")).join(rank, [*keys, "_t"], "left").withColumn("demand", F.coalesce("_r", F.lit(500)))
    w = Window.partitionBy(*keys, "group_no").orderBy("demand", "item")
    return df.withColumn("position", F.row_number().over(w)).drop("_t", "_r")


def skills_by_pool(skills: DataFrame, wanted: DataFrame, ev: DataFrame) -> DataFrame:
    """``skills_by_demand`` over all pairs that share a term: the rank of an item is looked up in the pool (posting, term, rank).

    Only documents that list skills meet postings, and a term that no item names is never paired.
    """
    ev = ev.select("doc_id", "term").join(skills.select("doc_id").distinct(), "doc_id", "left_semi")
    has = ev.select("doc_id", F.col("term").alias("_t"), F.lit(True).alias("_has"))
    items = skills.withColumn("_t", T.normalize_keyword("item")).join(has, ["doc_id", "_t"], "left")
    pairs = ev.repartition("doc_id").join(wanted.select("posting_id", "term"), "term").select("posting_id", "doc_id").distinct()
    rank = wanted.select("posting_id", F.col("term").alias("_t"), "rank")
    df = pairs.join(items, "doc_id").join(rank, ["posting_id", "_t"], "left")
    df = df.withColumn("demand", F.when(F.col("rank").isNull(), F.lit(500)).when(F.col("_has"), F.col("rank")).otherwise(F.lit(999)))
    w = Window.partitionBy("posting_id", "doc_id", "group_no").orderBy("demand", "item")
    return df.withColumn("position", F.row_number().over(w)).drop("_t", "_has", "rank")


def token_ends(tokens: Column | str, terms: Column | str) -> Column:
    """The terms that are the start or the end of a longer token."""
    def ends(sizes: Column) -> Column:
        return F.flatten(F.transform(T.col(tokens), lambda t: F.flatten(F.transform(
            F.filter(sizes, lambda n: n < F.length(t)), lambda n: F.array(F.substring(t, F.lit(1), n), F.substring(t, F.length(t) - n + 1, n))))))

    return F.array_intersect(T.let(F.array_distinct(F.transform(T.col(terms), lambda w: F.length(w))), ends), T.col(terms))


def promote_skills(matches: DataFrame, body_hits: DataFrame, skills: DataFrame, roles: DataFrame, bodies: DataFrame) -> DataFrame:
    """Matched HIGH / MEDIUM / user terms proven in the body: promoted, or skipped with the reason.

    ``bodies`` (doc, tokens): a term that also is the start or end of a longer token is a fragment.  The wanted
    terms of a document go to its one row, where only ends of their lengths are looked up: what is shuffled
    grows with the wanted terms, not with the ends of all tokens.  A null or empty list of tokens has no fragments.
    """
    wanted = matches.filter((F.col("status") != "MISSING") & F.col("can_insert") & (F.col("priority").isin("HIGH", "MEDIUM") | (F.col("source") != "jd")))
    wanted = wanted.filter(F.length("term") >= 2).join(
        skills.select("doc_id", T.normalize_keyword("item").alias("term")).distinct(), ["doc_id", "term"], "left_anti")
    mark = lambda df, name: df.select("doc_id", "term").distinct().withColumn(name, F.lit(True))
    asked = wanted.groupBy("doc_id").agg(F.collect_set("term").alias("_terms"))
    frags = bodies.join(asked, "doc_id").select("doc_id", F.explode(token_ends("tokens", "_terms")).alias("term"))
    df = wanted.join(mark(body_hits, "_hit"), ["doc_id", "term"], "left")
    df = df.join(mark(roles.select("doc_id", T.normalize_keyword("role").alias("term")), "_role"), ["doc_id", "term"], "left")
    df = df.join(mark(frags, "_frag"), ["doc_id", "term"], "left")
    reason = F.when(F.col("_hit").isNull(), "not in the body").when(F.col("_role"), "a job title").when(F.col("_frag"), "part of a longer term")
    return df.select("posting_id", "doc_id", "term", reason.isNull().alias("promoted"), F.coalesce(reason, F.lit("")).alias("reason"))


def draft_summary(roles: DataFrame, matches: DataFrame, k: int = 3) -> DataFrame:
    """``Role with experience in a, b and c.`` from supported terms; no text below 25 alphanumerics."""
    ok = matches.filter(((F.col("status") == "MATCHED") | F.col("can_insert")) & ((F.col("priority") == "HIGH") | (F.col("source") == "user")))
    w = Window.partitionBy("posting_id", "doc_id").orderBy("rank", "term")
    top = ok.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    lists = top.groupBy("posting_id", "doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "term"))), lambda s: s["term"]).alias("t"))
    n = F.size("t")
    words = F.when(n == 1, F.get("t", F.lit(0))).otherwise(F.concat(
        F.array_join(F.slice("t", F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at("t", -1)))
    df = lists.join(roles, "doc_id", "left")
    lead = F.coalesce(F.nullif("role", F.lit("")), F.lit("Professional"))
    text = T.end_with_period(T.capitalize_first(F.concat(lead, F.lit(" with experience in "), words)))
    return df.select("posting_id", "doc_id", text.alias("text")).filter(F.length(F.regexp_replace("text", "[^A-Za-z0-9]", "")) >= 25)


def compose_bullets(bullets: DataFrame, clean_rules: Sequence[tuple[str, str]] = tuple(dims.CLEANUP_RULES)) -> tuple[DataFrame, DataFrame]:
    """The rewrite of a bullet: stronger verb, then tense, then clean-up, each on what the step before left.

    Returns the bullets with ``upgraded``, ``tensed`` and ``clean`` (the new text) beside the old ``text``,
    and the advice rows of upgrades that would have claimed more.
    """
    rows, advice = upgrade_verbs(bullets)
    rows = rows.withColumn("_old", F.col("text")).withColumn("text", F.col("upgraded"))
    rows = normalize_tense(rows).withColumn("text", F.col("tensed"))
    rows = clean_bullets(rows, clean_rules).withColumn("text", F.col("_old")).drop("_old")
    return rows, advice


COMPOSED_STEPS = (("action-verb", "text", "upgraded"), ("tense", "upgraded", "tensed"), ("grammar", "tensed", "clean"))


def change_log(df: DataFrame, keys: Sequence[str], steps: Sequence[tuple[str, str, str]] = COMPOSED_STEPS, advice: DataFrame | None = None) -> DataFrame:
    """One row per step (type, column before, column after) that changed a row.

    ``advice`` (keys, text, advice) adds one row per upgrade left to the writer: from the text, to the opener it names.
    """
    rows = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(False).alias("advice"), F.col(a).alias("from"), F.col(b).alias("to")) for t, a, b in steps])
    out = df.select(*keys, F.explode(F.filter(rows, lambda r: r["from"] != r["to"])).alias("c")).select(*keys, "c.*")
    if advice is None:
        return out
    return out.unionByName(advice.select(*keys, F.lit("action-verb").alias("type"), F.lit(True).alias("advice"), F.col("text").alias("from"), F.col("advice").alias("to")))


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("type", "advice").agg(F.count(F.lit(1)).alias("n"))
