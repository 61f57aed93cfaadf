"""Text to ordered lines, sections and section-level facts.

A document is one row, so its lines come out of one row; the windows below are
keyed by document and only ever hold what one stored text held.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom import fixed_values as fv
from termloom.functions import text as T
from termloom.session import write_once


def to_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per non-empty line; line_no is the position in the source text."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw"))
    # tested on the raw line, so that no filter works the text out a second time
    return annotate_lines(lines.filter(F.col("raw").rlike(f"[^{T.SPACES} ]")).withColumn("text", T.collapse_ws("raw"))).drop("raw")


def annotate_lines(lines: DataFrame) -> DataFrame:
    """Adds is_bullet, marker, bullet_text, numbered; a given is_bullet flag is kept."""
    known = F.col("is_bullet") if "is_bullet" in lines.columns else F.lit(False)
    b = T.bullet_prefix("text")
    return (
        lines.withColumn("_b", b)
        .withColumn("is_bullet", F.col("_b.marker").isNotNull() | F.coalesce(known, F.lit(False)))
        .withColumn("marker", F.col("_b.marker"))
        .withColumn("bullet_text", T.collapse_ws(F.coalesce("_b.rest", "text")))
        .withColumn("numbered", F.coalesce("_b.numbered", F.lit(False)))
        .drop("_b")
    )


def normalize_heading(c: Column | str) -> Column:
    return F.lower(T.collapse_ws(F.regexp_replace(T.col(c), r"[:._|*#\x{2022}\x{2013}\x{2014}-]+", " ")))


def running_sizes(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, upto, total): how often each value occurs, with a running sum from the least value; nulls do not count.

    Only the distinct values of a key meet in a task, however many rows have them.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    return counts.withColumns({"upto": F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)})


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, name): the value at n/2 of the sorted ones, the upper one of two middle values; keys without a value have no row."""
    beyond = F.col("upto") > F.floor(F.col("total") / 2)
    return running_sizes(df, keys, value).groupBy(*keys).agg(F.min(F.when(beyond, F.col(value))).alias(name))


def heading_flag(lines: DataFrame, aliases: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds heading_key and is_heading (alias hit, larger face, or bold and short).

    The alias table is joined by equality, so Spark broadcasts it while it is
    small and shuffles otherwise.  Face rules apply where font columns exist.
    """
    short = (F.length("text") <= 64) & (F.size(F.split("text", " ")) <= 6) & ~F.col("is_bullet")
    df = lines.withColumn("heading_key", normalize_heading("text"))
    names = aliases.select(F.col("alias").alias("heading_key"), F.lit(True).alias("_alias")).distinct()
    df = df.join(names, "heading_key", "left")
    hit = F.coalesce("_alias", F.lit(False))
    if "font_size" in lines.columns:
        body = upper_median(lines.filter(~F.col("is_bullet")), [key], "font_size", "_body")
        df = df.join(body, key, "left")
        n = F.length("heading_key")
        hit = hit | F.coalesce((F.col("font_size") >= F.col("_body") * 1.06) & n.between(3, 60), F.lit(False))
        letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
        few = F.size(F.split("heading_key", " ")) <= 5
        hit = hit | F.coalesce(F.col("bold") & (n <= 48) & few & (letters >= 3), F.lit(False))
    return df.withColumn("is_heading", short & hit).drop("_alias", "_body")


def section_lookup(headings: DataFrame, aliases: DataFrame) -> DataFrame:
    """section_id per heading_key: exact alias, alias without years, then longest-known prefix order.

    The prefix rule is an equi-join on the prefixes of the heading (headings are
    at most 64 characters), not a range of LIKE tests.
    """
    keys = headings.select("heading_key").distinct()
    stripped = T.collapse_ws(F.regexp_replace("heading_key", r"(^|[^a-z0-9_])(19|20)\d{2}($|[^a-z0-9_])", "$1$3"))
    forms = keys.withColumn("stripped", stripped)
    cand = forms.select("heading_key", F.explode(
        F.concat(
            F.array(F.struct(F.lit(0).alias("kind"), F.col("heading_key").alias("alias"))),
            F.array(F.struct(F.lit(1).alias("kind"), F.col("stripped").alias("alias"))),
            F.when(
                F.length("stripped") >= 4,
                F.transform(
                    F.sequence(F.lit(4), F.length("stripped")),
                    lambda n: F.struct(F.lit(2).alias("kind"), F.substring(F.col("stripped"), F.lit(1), n).alias("alias")),
                ),
            ).otherwise(F.array()),
        )).alias("c")).select("heading_key", "c.kind", "c.alias")
    found = cand.join(aliases, "alias").groupBy("heading_key").agg(
        F.min_by("section_id", F.struct("kind", "alias_order")).alias("section_id"))
    return keys.join(found, "heading_key", "left")


def segment_sections(lines: DataFrame, aliases: DataFrame, weak: list[str], key: str = "doc_id") -> DataFrame:
    """Adds section_no and section_id to every line (0 / null = header before the first heading).

    A heading opens a section unless it repeats the section that is already
    running with content, or is a weak label inside a section with content.
    Documents without any heading are one section ``other``.
    """
    df = heading_flag(lines, aliases, key)
    found = write_once(section_lookup(df.filter("is_heading"), aliases), "heading_sections")  # its size is known to the join with all lines
    df = df.join(found, "heading_key", "left").withColumn(
        "head_id", F.when(F.col("is_heading"), F.col("section_id"))).drop("section_id")
    return _number_sections(df, weak, key)


def _number_sections(df: DataFrame, weak: list[str], key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    is_head = F.col("head_id").isNotNull()
    df = df.withColumn("_body", F.sum((~is_head).cast("int")).over(upto))
    df = df.withColumn("_prev_body", F.last(F.when(is_head, F.col("_body")), True).over(before))
    df = df.withColumn(
        "_weak",
        is_head & F.col("heading_key").isin(weak) & F.coalesce(F.col("_body") > F.col("_prev_body"), F.lit(False)))
    main = is_head & ~F.col("_weak")
    df = df.withColumn("_prev_id", F.last(F.when(main, F.col("head_id")), True).over(before))
    df = df.withColumn("_turn", main & ~F.col("head_id").eqNullSafe(F.col("_prev_id")))
    df = df.withColumn("_turn_body", F.last(F.when(F.col("_turn"), F.col("_body")), True).over(upto))
    df = df.withColumn("is_section_start", main & (F.col("_turn") | (F.col("_body") == F.col("_turn_body"))))
    df = df.withColumn("section_no", F.sum(F.col("is_section_start").cast("int")).over(upto))
    df = df.withColumn("section_id", F.last(F.when(F.col("is_section_start"), F.col("head_id")), True).over(upto))
    none = F.max(F.col("section_no")).over(Window.partitionBy(key)) == 0
    df = df.withColumn("section_id", F.when(none, F.lit("other")).otherwise(F.col("section_id")))
    df = df.withColumn("in_body", ~is_head | none)
    return df.drop("_body", "_prev_body", "_weak", "_prev_id", "_turn", "_turn_body", "head_id")


def sections(segmented: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per section: id, title, first line, number of body lines."""
    return (
        segmented.filter(F.col("section_id").isNotNull())
        .groupBy(key, "section_no", "section_id")
        .agg(
            F.coalesce(F.max(F.when(F.col("is_section_start"), F.regexp_replace("text", r"[:\s]+$", ""))), F.lit("")).alias("title"),
            F.min("line_no").alias("first_line"),
            F.count_if("in_body").alias("line_count"),
        )
    )


def join_wrapped_bullets(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """A line without a marker continues the bullet above it."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        lines.withColumn("bullet_no", F.sum(F.col("is_bullet").cast("int")).over(w))
        .filter("bullet_no > 0")
        .groupBy(key, "bullet_no")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("line_no", "bullet_text"))), lambda s: s["bullet_text"]),
                " ",
            ).alias("text"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )


def section_diagnostics(secs: DataFrame, canonical: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Canonical sections a document lacks, as a sorted list plus a count."""
    names = [r for r in fv.SECTION_ORDER if r != "contact"]
    found = secs.groupBy(key).agg(F.collect_set("section_id").alias("found"))
    missing = F.array_except(F.array(*[F.lit(n) for n in names]), F.coalesce("found", F.array().cast("array<string>")))
    return docs.select(key).join(found, key, "left").select(
        key, F.array_join(missing, ",").alias("missing"), F.size(missing).alias("n_missing"))


def present_sections(secs: DataFrame, counts: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Sections with content in document order; ``counts`` (key, section_id, n) overrides line counts."""
    first = secs.filter((F.col("section_id") != "contact") & (F.col("line_count") > 0)).groupBy(key, "section_id").agg(
        F.min("section_no").alias("_first"))
    if counts is not None:
        first = first.join(counts.filter("n > 0").select(key, "section_id"), [key, "section_id"], "left_semi")
    w = Window.partitionBy(key).orderBy("_first")
    return first.withColumn("position", F.row_number().over(w)).drop("_first")


def insert_summary(present: DataFrame, drafted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Put a drafted summary before the first body section of documents that lack one."""
    body = ["experience", "skills", "education", "certifications"]
    at = present.groupBy(key).agg(
        F.min(F.when(F.col("section_id").isin(body), F.col("position"))).alias("_at"), F.max("position").alias("_n"),
        F.max((F.col("section_id") == "summary").cast("int")).alias("_has"))
    new = drafted.select(key).join(at, key, "left").filter(F.coalesce("_has", F.lit(0)) == 0).select(
        key, F.lit("summary").alias("section_id"), (F.coalesce(F.col("_at") - 0.5, F.coalesce("_n", F.lit(0)) + 1.0)).alias("_p"))
    both = present.select(key, "section_id", F.col("position").cast("double").alias("_p")).unionByName(new)
    return both.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("_p"))).drop("_p")


def canonical_order_score(present: DataFrame, canonical: DataFrame, key: str = "doc_id") -> DataFrame:
    """100 minus the share of neighbours out of canonical order; 60 below two sections."""
    w = Window.partitionBy(key).orderBy("position")
    df = present.join(canonical, "section_id").withColumn("_prev", F.lag("canonical_pos").over(w))
    n, inv = F.count(F.lit(1)), F.count_if(F.col("canonical_pos") < F.col("_prev"))
    return df.groupBy(key).agg(
        F.when(n < 2, F.lit(60)).otherwise(T.clamp_pct(100.0 - inv * 100.0 / F.greatest(n - 1, F.lit(1)))).alias("order_score"))
