"""Comparing two versions of a text: evidence guard, differences, bullet pairing, near duplicates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom import fixed_values as fv
from termloom.functions import text as T
from termloom.session import write_once

NUMBER = r"(?:^|[^a-zA-Z0-9_])((?:[$\x{20AC}\x{00A3}\x{20B9}]\s?)?\d[\d,.]*)((?:\s?[a-zA-Z%]+)?)"
ENTITY = r"(?:^|[^a-zA-Z0-9_])([A-Z][a-zA-Z0-9]*(?:\s+[A-Z][a-zA-Z0-9]*)+)"


def consecutive(versions: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, order, before, after): version n next to version n + 1, joined by equality so a long history spreads."""
    a = versions.select(key, F.col(order), F.col(text).alias("before"))
    b = versions.select(key, (F.col(order) - 1).alias(order), F.col(text).alias("after"))
    return a.join(b, [key, order])


# --------------------------------------------------------------------- guard
def numbers(c: Column | str) -> Column:
    """Distinct numbers with their unit, normalised."""
    n = F.regexp_extract_all(T.col(c), F.lit(NUMBER), 1)
    u = F.regexp_extract_all(T.col(c), F.lit(NUMBER), 2)
    join = lambda a, b: F.concat(F.regexp_replace(a, "[.,]+$", ""), F.when(F.lower(F.trim(b)).isin(fv.NUMBER_UNITS), F.lower(b)).otherwise(""))
    return F.array_distinct(F.zip_with(n, u, join))


def entities(c: Column | str) -> Column:
    """Distinct runs of two or more capitalised words, normalised."""
    return F.array_distinct(F.transform(F.regexp_extract_all(T.col(c), F.lit(ENTITY), 1), lambda e: T.soft_normalize(e)))


def _new(pairs: DataFrame, keys: Sequence[str], value, rule: str, severity: str) -> DataFrame:
    # both versions sit in one row: a set difference of arrays needs no shuffle
    return pairs.select(*keys, F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                        F.explode(F.array_except(value("after"), value("before"))).alias("term"))


def new_numbers(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _new(pairs, keys, numbers, "new-number", "critical")


def new_entities(pairs: DataFrame, keys: Sequence[str], insertable: DataFrame | None = None) -> DataFrame:
    out = _new(pairs, keys, entities, "new-term", "warning")
    return out if insertable is None else out.join(insertable.select(*keys, "term"), [*keys, "term"], "left_anti")


def leaked_terms(hits_before: DataFrame, hits_after: DataFrame, missing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing terms the new version shows and the old one did not."""
    new = hits_after.join(missing.select("term").distinct() if "term" in missing.columns and len(missing.columns) == 1 else missing,
                          "term" if len(missing.columns) == 1 else [*keys, "term"], "left_semi")
    new = new.join(hits_before.select(*keys, "term"), [*keys, "term"], "left_anti")
    return new.select(*keys, F.lit("unsupported-keyword").alias("rule"), F.lit("critical").alias("severity"), "term")


def changed_header(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str] = ("company", "role")) -> DataFrame:
    b = before.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    j = after.join(b, list(keys))
    rows = F.array(*[F.when(~T.normalize_keyword(f).eqNullSafe(T.normalize_keyword(f"_{f}")), F.struct(
        F.lit(f"{f}-changed").alias("rule"), F.col(f).alias("term"))) for f in fields])
    return j.select(*keys, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select(
        *keys, "r.rule", F.lit("critical").alias("severity"), "r.term")


def added_items(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, rule: str) -> DataFrame:
    """Items of the new version (credentials, schools) the old one does not list."""
    k = T.normalize_keyword(value)
    old = before.select(*keys, k.alias("_k"))
    new = after.withColumn("_k", k).filter("_k <> ''").join(old, [*keys, "_k"], "left_anti")
    return new.select(*keys, F.lit(rule).alias("rule"), F.lit("critical").alias("severity"), F.col(value).alias("term"))


def added_skills(skills_after: DataFrame, hits_before: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Skills neither evidenced by the source text nor allow-listed."""
    s = skills_after.withColumn("term", T.normalize_keyword("item"))
    s = s.join(hits_before.select(*keys, "term"), [*keys, "term"], "left_anti").join(allowed.select(*keys, "term"), [*keys, "term"], "left_anti")
    return s.select(*keys, F.lit("skill-added").alias("rule"), F.lit("critical").alias("severity"), F.col("item").alias("term"))


def guard_verdict(pairs: DataFrame, issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """passed = no critical issue; pairs without issues pass."""
    n = issues.groupBy(*keys).agg(F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count(F.lit(1)).alias("n_issues"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return pairs.select(*keys).join(n, list(keys), "left").select(
        *keys, (z("n_critical") == 0).alias("passed"), z("n_critical").alias("n_critical"), z("n_issues").alias("n_issues"))


# --------------------------------------------------------------------- differences
def word_diff_stats(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words added and removed per pair, as multisets, inside the row: the signed words are sorted and folded in one pass."""
    words = lambda c: F.filter(F.split(T.collapse_ws(c), " "), lambda w: w != "")
    signed = F.concat(F.transform(words(F.coalesce("before", F.lit(""))), lambda w: F.struct(w.alias("w"), F.lit(-1).alias("d"))),
                      F.transform(words(F.coalesce("after", F.lit(""))), lambda w: F.struct(w.alias("w"), F.lit(1).alias("d"))))

    def closed(acc: Column) -> tuple[Column, Column]:
        return acc["added"] + F.greatest(acc["s"], F.lit(0)), acc["removed"] + F.greatest(-acc["s"], F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        same = acc["w"] == x["w"]
        added, removed = closed(acc)
        return F.struct(x["w"].alias("w"), F.when(same, acc["s"] + x["d"]).otherwise(x["d"]).alias("s"),
                        F.when(same, acc["added"]).otherwise(added).alias("added"), F.when(same, acc["removed"]).otherwise(removed).alias("removed"))

    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("s"), F.lit(0).alias("added"), F.lit(0).alias("removed"))
    folded = F.aggregate(F.array_sort(signed), start, step, lambda acc: F.struct(*[c.alias(n) for c, n in zip(closed(acc), ("added", "removed"))]))
    return pairs.select(*keys, folded.alias("_d")).select(*keys, "_d.added", "_d.removed")


def diff_totals(stats: DataFrame, key: str) -> DataFrame:
    return stats.groupBy(key).agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"),
                                  F.count_if((F.col("added") > 0) | (F.col("removed") > 0)).alias("changed"))


def field_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Changed scalar fields, one row each."""
    long = lambda df, name: df.select(*keys, F.explode(F.create_map(*[
        x for f in fields for x in (F.lit(f), F.coalesce(F.col(f).cast("string"), F.lit("")))])).alias("field", name))
    j = long(before, "from").join(long(after, "to"), [*keys, "field"], "full")
    z = lambda c: F.coalesce(c, F.lit(""))
    return j.select(*keys, "field", z("from").alias("from"), z("to").alias("to")).filter(F.col("from") != F.col("to"))


def version_pair(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Components of two versions side by side; unmoved ones below 100 are flagged."""
    a = before.select(*keys, "component", F.col("value").alias("before"))
    b = after.select(*keys, "component", F.col("value").alias("after"))
    return a.join(b, [*keys, "component"]).withColumn("delta", F.col("after") - F.col("before")).withColumn(
        "unmoved", (F.col("delta") == 0) & (F.col("after") < 100))


# --------------------------------------------------------------------- bullets
PAIR_BLOCK = 128  # texts of one side that meet as many of the other in one row


def _blocks(texts: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(keys, settled, _c, texts): the distinct texts of an entry in lists of about ``block``, dealt by their hash."""
    sizes = texts.groupBy(*keys, "settled").agg(F.ceil(F.count(F.lit(1)) / block).alias("_m"))
    dealt = texts.join(sizes, [*keys, "settled"]).withColumn("_c", F.pmod(F.xxhash64("text"), F.col("_m")))
    return dealt.groupBy(*keys, "settled", "_c").agg(F.collect_list(F.struct("no", F.trim(F.lower("text")).alias("t"))).alias("texts"))


def _block_best(a: DataFrame, b: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, side, no, sim, partner): best partner above the threshold that each text meets in the blocks, ties to the lower one.

    Blocks of two settled lists do not meet. The distance is only worked out up to the largest that is accepted.
    """
    met = a.select(*keys, F.col("settled").alias("_sa"), F.col("_c").alias("_ca"), F.col("texts").alias("A")).join(
        b.select(*keys, F.col("settled").alias("_sb"), F.col("_c").alias("_cb"), F.col("texts").alias("B")), keys).filter("not (_sa and _sb)")
    # rows are small for the work in them: dealt by a given number, so that no task is put together by bytes
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(n, *keys, "_sa", "_ca", "_sb", "_cb")

    def sim(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        most = F.floor(longest * (1 - threshold)).cast("int") + 1
        s = F.lit(1.0) - F.call_function("levenshtein", x, y, most) / longest
        ok = (F.least(F.length(x), F.length(y)) > longest * threshold) & (s > threshold) & (s <= 1.0)
        return F.when(ok, s)

    grid = F.transform("A", lambda x: F.transform("B", lambda y: sim(x["t"], y["t"])))
    top = lambda s, y: F.when(s.isNotNull(), F.struct(s.alias("sim"), (-y["no"]).alias("neg")))
    row = lambda side, x, best: F.struct(F.lit(side).alias("side"), x["no"].alias("no"), F.array_max(best).alias("m"))
    both = T.let(grid, lambda g: F.concat(
        F.transform("A", lambda x, i: row("a", x, F.zip_with(F.get(g, i), "B", top))),
        F.transform("B", lambda y, j: row("b", y, F.zip_with(F.transform(g, lambda r: F.get(r, j)), "A", top)))))
    rows = met.select(*keys, F.explode(both).alias("r")).filter("r.m is not null")
    best = rows.groupBy(*keys, "r.side", "r.no").agg(F.max("r.m").alias("m"))
    return best.select(*keys, "side", "no", F.col("m.sim").alias("sim"), (-F.col("m.neg")).alias("partner"))


def pair_bullets(pairs: DataFrame, keys: Sequence[str], threshold: float = 0.34, block: int = PAIR_BLOCK) -> DataFrame:
    """Best partner of each bullet between two versions, accepted where it is mutual; ties go to the lower position.

    Expects arrays ``before`` and ``after`` of the bullets of one entry; ``keys`` name a row of ``pairs``.  Bullets
    with equal normalised text are settled by an equi-join.  At so low a threshold no gram has to be shared, so the
    distinct texts of the rest meet the other side in blocks: a row holds two lists of about ``block`` texts and
    yields the best of each, so an entry of any size spreads over tasks and no pair leaves its row.  A null array is
    empty; a null bullet and a bullet under a null key pair with nothing.
    """
    keys = list(keys)

    def side(c: str) -> DataFrame:
        rows = pairs.select(*keys, F.posexplode(c).alias("no", "text"))
        return write_once(rows.withColumn("key", T.normalize_keyword("text")), f"bullets_{c}")

    sides = {"a": side("after"), "b": side("before")}
    firsts = {s: x.groupBy(*keys, "key").agg(F.min("no").alias("equal_no")) for s, x in sides.items()}
    held = {s: write_once(sides[s].join(firsts["b" if s == "a" else "a"], [*keys, "key"], "left"), f"settled_{s}") for s in "ab"}
    texts = {s: x.filter("text is not null").groupBy(*keys, "text").agg(
        F.min("no").alias("no"), F.first("equal_no").isNotNull().alias("settled")) for s, x in held.items()}
    best = write_once(_block_best(_blocks(texts["a"], keys, block), _blocks(texts["b"], keys, block), keys, threshold), "block_best")

    def choice(s: str) -> DataFrame:
        """(keys, own, other, sim) of the bullets of a side that have a best partner."""
        mine = best.filter(F.col("side") == s).join(texts[s].select(*keys, "no", "text"), [*keys, "no"]).select(*keys, "text", "sim", "partner")
        free = held[s].filter("equal_no is null").join(mine, [*keys, "text"]).select(*keys, F.col("no").alias("own"), F.col("partner").alias("other"), "sim")
        return held[s].filter("equal_no is not null").select(*keys, F.col("no").alias("own"), F.col("equal_no").alias("other"), F.lit(1.0).alias("sim")).unionByName(free)

    of_a = choice("a").select(*keys, F.col("own").alias("to_no"), F.col("other").alias("from_no"), "sim")
    of_b = choice("b").select(*keys, F.col("other").alias("to_no"), F.col("own").alias("from_no"))
    matched = write_once(of_a.join(of_b, [*keys, "to_no", "from_no"]), "matched")
    a = sides["a"].select(*keys, F.col("no").alias("to_no"), F.col("text").alias("to"))
    b = sides["b"].select(*keys, F.col("no").alias("from_no"), F.col("text").alias("from"))
    kept = a.join(matched.join(b, [*keys, "from_no"]), [*keys, "to_no"], "left")
    kind = F.when(F.col("from_no").isNull(), "added").when(F.col("from") == F.col("to"), "unchanged").otherwise("rewritten")
    cols = [*keys, "kind", "from_no", "to_no", "from", "to", "sim"]
    kept = kept.withColumns({"kind": kind, "sim": F.floor(F.col("sim") * 100 + 0.5) / 100.0}).select(*cols)
    gone = b.join(matched, [*keys, "from_no"], "left_anti")
    gone = gone.withColumns({"kind": F.lit("removed"), "to_no": F.lit(None).cast("int"), "to": F.lit(None).cast("string"), "sim": F.lit(None).cast("double")})
    return kept.unionByName(gone.select(*cols))


GRAM = 5
SHORTEST = 11  # similarity counts only for texts of more than ten characters
CLASS_BUCKETS = 1 << 16


def _most_edits(n: int, threshold: float) -> int:
    return math.floor(n * (1 - threshold) / threshold + 1e-9)


def _gram_length(threshold: float) -> int:
    """Longest gram, up to GRAM, of which every text has more than the edits within the threshold can destroy."""
    for q in range(GRAM, 0, -1):
        rate = q * (1 - threshold) / threshold
        if rate < 1 and all(q * _most_edits(n, threshold) <= n - q for n in range(SHORTEST, max(SHORTEST, math.ceil(q / (1 - rate))) + 2)):
            return q
    raise ValueError(f"near duplicates need a similarity above one half, not {threshold}")


def _text_grams(s: Column, q: int) -> Column:
    """Hashes of all grams of q characters, repeats included."""
    # characters once as an array: substring would walk the text again for every gram
    return T.let(F.split(s, ""), lambda ch: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(ch) - q, F.lit(0))), lambda i: F.xxhash64(*[F.get(ch, i + k) for k in range(q)])))


def _gram_classes(rows: DataFrame) -> Column:
    """Literal array: how frequent (as a power of two) the grams of each of CLASS_BUCKETS hash buckets are in all rows.

    A histogram of fixed size; it decides the order in which grams are probed and never which pairs are found.
    """
    seen = rows.select(F.explode("grams").alias("g")).groupBy(F.pmod("g", F.lit(CLASS_BUCKETS)).cast("int").alias("b")).count().collect()
    classes = [0] * CLASS_BUCKETS
    for r in seen:
        classes[r["b"]] = r["count"].bit_length()
    return F.split(F.lit(",".join(map(str, classes))), ",").cast("array<int>")


def _probes(grams: Column, n: Column, q: int, threshold: float, classes: Column) -> Column:
    """Gram hashes of which two texts above the threshold share at least one, rare ones first.

    A near pair differs in at most d = n * (1 - threshold) / threshold edits, each of which destroys at most q
    grams.  The grams are a multiset: under any common order the smallest q * d + 1 of both sides, repeats
    counted, have to meet, and every text has that many.  Rare grams stand first, so what all lines of a document
    have in common seldom is a probe (a shared hash can only add a candidate).
    """
    keep = (F.floor(n * ((1 - threshold) / threshold) + 1e-9) * q + 1).cast("int")
    ranked = F.transform(grams, lambda g: F.shiftleft(F.get(classes, F.pmod(g, F.lit(CLASS_BUCKETS)).cast("int")).cast("long"), 57)
                         .bitwiseOR(F.shiftrightunsigned(g, 7)))
    return F.array_distinct(F.slice(F.sort_array(ranked), F.lit(1), keep))


def _shared_probes(rows: DataFrame, keys: list[str], q: int, threshold: float, classes: Column) -> DataFrame:
    """(keys, no, n, len, _d, tok): the probes that another text of the entry within reach in length has too.

    In order of length the nearest neighbours tell whether any text is within reach.  Texts are dealt by entry once
    and their probes stay in the task, so what is shuffled is the text and not a row per gram.
    """
    def near(by: list[str]) -> Column:
        o = Window.partitionBy(*keys, *by).orderBy("n")
        return F.coalesce(F.lag("n").over(o) > F.col("n") * threshold, F.lit(False)) | F.coalesce(F.col("n") > F.lead("n").over(o) * threshold, F.lit(False))

    dealt = rows.repartition(*keys).withColumn("_near", near([])).filter("_near").drop("_near")
    tok = F.explode(_probes(_text_grams(F.col("_s"), q), F.col("n"), q, threshold, classes)).alias("tok")
    probes = dealt.select(*keys, "no", "n", "len", "_d", tok)
    return probes.withColumn("_near", near(["tok"])).filter("_near").drop("_near")


def near_dup_bullets(bullets: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "bullet_no", threshold: float = 0.9) -> DataFrame:
    """Adds dropped: a longer (or equal and earlier) near duplicate exists in the same entry.

    Near: same normalised text, or similarity above 0.9.  The first is an
    aggregate; only for the second are candidates formed, between texts that
    share a probe.  Of rows with equal text only the best ranked is offered as a
    partner: it dominates its copies, so a line copied a million times is met once.
    A null text, and a row under a null key, is no duplicate of another text.
    """
    keys, q = list(keys), _gram_length(threshold)
    rank = F.struct(F.length("text").alias("len"), (-F.col(order)).alias("neg"))
    b = bullets.withColumn("_key", T.normalize_keyword("text")).withColumn("_rank", rank).withColumn("_s", F.trim(F.lower("text")))
    same = F.coalesce(F.nullif("_key", F.lit("")), F.when(F.length("_s") > 10, F.col("_s")))
    b = b.withColumn("_key", same)
    by_key = b.filter("_key is not null").groupBy(*keys, "_key").agg(F.max("_rank").alias("_best_key"))
    b = b.join(by_key, [*keys, "_key"], "left")
    b = b.withColumn("_d", F.coalesce(F.col("_rank") < F.col("_best_key"), F.lit(False)))
    n = F.length("_s")
    rows = write_once(b.filter(n >= SHORTEST).groupBy(*keys, "_s").agg(F.max_by(F.struct(F.col(order).alias("no"), F.length("text").alias("len"), F.col("_d")), "_rank").alias("_t")).select(
        *keys, "_t.no", n.alias("n"), "_t.len", "_t._d", "_s"), "near_rows")
    grams = _text_grams(F.col("_s"), q)  # worked out where they are read: as a column they are many times the text
    classes = _gram_classes(rows.select(grams.alias("grams")))
    met = write_once(_shared_probes(rows, keys, q, threshold, classes), "shared_probes")
    x = met.filter(~F.col("_d")).select(*keys, F.col("no").alias("x"), F.col("n").alias("xn"), F.col("len").alias("xl"), "tok")
    y = met.select(*keys, F.col("no").alias("y"), F.col("n").alias("yn"), F.col("len").alias("yl"), "tok")
    better = (F.col("yl") > F.col("xl")) | ((F.col("yl") == F.col("xl")) & (F.col("y") < F.col("x")))
    cand = x.join(y, [*keys, "tok"]).filter(better & (F.least("xn", "yn") > F.greatest("xn", "yn") * threshold))
    cand = cand.select(*keys, "x", "y").distinct()
    t1 = rows.select(*keys, F.col("no").alias("x"), F.col("_s").alias("xs"))
    t2 = rows.select(*keys, F.col("no").alias("y"), F.col("_s").alias("ys"))
    both = cand.join(t1, [*keys, "x"]).join(t2, [*keys, "y"])
    longer = F.greatest(F.length("xs"), F.length("ys"))
    # the distance is only worked out up to the largest that still is near
    d = F.expr(f"levenshtein(xs, ys, cast(greatest(length(xs), length(ys)) * {1 - threshold:.6f} as int) + 1)")
    lost = both.filter((d >= 0) & (1.0 - d / longer > threshold))
    lost = lost.select(*keys, F.col("x").alias(order), F.lit(True).alias("_l")).distinct()
    return b.join(lost, [*keys, order], "left").select(
        *[c for c in bullets.columns], (F.col("_d") | F.coalesce("_l", F.lit(False))).alias("dropped"))
