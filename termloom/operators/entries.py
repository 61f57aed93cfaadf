"""Section bodies to entries, bullets, skills and items.

Boundaries come from lead/lag features and running counts, so every step is a
window or an aggregate keyed by document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom import dims
from termloom import fixed_values as fv
from termloom.functions import terms as K
from termloom.functions import text as T
from termloom.operators import lines as L

LIST_SPLIT = r"\s*(?:,|;|\||\x{2022}|\x{2023}|\x{25AA}|\n)\s*|\s+/\s+"
SKILL_LABEL = r"^([^:]{1,33}):\s*(.*)$"
YEAR_ONLY = rf"^\s*{fv.YEAR}\s*$"


def split_list(c: Column) -> Column:
    parts = F.transform(F.split(c, LIST_SPLIT), lambda s: F.trim(F.regexp_replace(s, r"^[-*\x{2022}\x{2013}\x{2014}]\s*", "")))
    return F.filter(parts, lambda s: s != "")


def body_text() -> Column:
    return F.when(F.col("is_bullet"), F.col("bullet_text")).otherwise(F.col("text"))


def entry_boundaries(
    lines: DataFrame,
    roles: Sequence[str] = tuple(dims.ROLE_WORDS),
    companies: Sequence[str] = tuple(dims.COMPANY_WORDS),
    keys: Sequence[str] = ("doc_id", "section_no"),
) -> DataFrame:
    """Adds entry_no and kind (header / bullet / para / wrap) to the lines of one kind of section.

    A block is a bullet plus the unmarked lines under it.  Inside a block the
    first header candidate after each date opens an entry; undated lines behind
    it still belong to its header.
    """
    keys = list(keys)
    has_font = "font_size" in lines.columns
    font = F.col("font_size") if has_font else F.lit(None).cast("double")
    bold = F.coalesce(F.col("bold"), F.lit(False)) if "bold" in lines.columns else F.lit(False)
    sub = F.coalesce(F.col("heading_level") > 0, F.lit(False)) if "heading_level" in lines.columns else F.lit(False)
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    caps = (F.length("text") <= 48) & (F.size(F.split("text", " ")) <= 5) & (F.length(letters) >= 3) & (letters == F.upper(letters))
    df = lines.filter(F.col("is_bullet") | ~(sub | caps))
    if has_font:
        df = df.join(L.upper_median(lines.filter("font_size > 0"), keys, "font_size", "_body"), keys, "left")
    else:
        df = df.withColumn("_body", F.lit(None).cast("double"))

    w = Window.partitionBy(*keys).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    t = body_text()
    plain = ~F.col("is_bullet")
    df = (
        df.withColumn("_t", t)
        .withColumn("_date", T.extract_date(t))
        .withColumn("_range", T.has_date_range(t) | T.is_current(t))
        .withColumn("_role", K.looks_like_role(t, roles))
        .withColumn("_company", K.looks_like_company(t, companies))
        .withColumn("_segs", F.size(K.header_segments(t)))
        .withColumn("_first", F.row_number().over(w) == 1)
        .withColumn("_block", F.sum(F.col("is_bullet").cast("int")).over(upto))
    )
    date_only = plain & (F.col("_date") != "") & (F.trim(F.replace(F.col("_t"), F.col("_date"), F.lit(""))) == "")
    nxt, nxt2 = F.lead("_t", 1).over(w), F.lead("_t", 2).over(w)
    next_bullet = F.coalesce(F.lead("is_bullet", 1).over(w), F.lit(False))
    soon = F.coalesce(F.lead("_range", 1).over(w), F.lit(False)) | F.coalesce(F.lead("_range", 2).over(w), F.lit(False))
    next_short = F.coalesce((F.length(nxt) <= 90) & ~nxt.rlike("[.!?]$"), F.lit(False)) & ~next_bullet
    bigger = F.coalesce(font > F.col("_body") * 1.02, F.lit(False))
    gap = F.coalesce(~F.lag("is_bullet").over(w) & (font > F.lag(font).over(w) * 1.05), F.lit(False)) if has_font else F.lit(False)
    many = F.col("_segs") > 1
    header = (F.length("_t") <= 90) & (
        (F.col("_range") & (F.col("_company") | F.col("_role") | many))
        | (F.col("_company") & many)
        | (F.col("_role") & (soon | next_short | next_bullet))
        | ((bigger | bold) & ~F.col("_t").rlike("[.!?]$") & (F.col("_role") | F.col("_company") | many))
        | gap
    )
    df = df.withColumn("_date_only", date_only).withColumn(
        "_cand", plain & ~F.col("_date_only") & (header | (F.col("_first") & (F.col("_block") == 0))))
    # dated lines seen before this one inside the block
    wb = Window.partitionBy(*keys, "_block").orderBy("line_no")
    dated = (plain & (F.col("_date") != "") & (F.col("_range") | F.col("_date_only"))).cast("int")
    df = df.withColumn("_d", F.coalesce(F.sum(dated).over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wd = Window.partitionBy(*keys, "_block", "_d").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_nth", F.sum(F.col("_cand").cast("int")).over(wd))
    df = df.withColumn("_open", F.col("_first") | (F.col("_cand") & (F.col("_nth") == 1)))
    wbu = wb.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_open_d", F.last(F.when(F.col("_open") & plain, F.col("_d")), True).over(wbu))
    df = df.withColumn("entry_no", F.sum(F.col("_open").cast("int")).over(upto))
    kind = (
        F.when(F.col("is_bullet"), "bullet")
        .when(F.col("_open") | F.col("_date_only"), "header")
        .when(F.col("_open_d").isNull(), "wrap")
        .when(F.col("_d") == F.col("_open_d"), "header")
        .otherwise("para")
    )
    df = df.withColumn("kind", kind).withColumn("body", F.col("_t"))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def entry_bullets(bounded: DataFrame, keys: Sequence[str] = ("doc_id", "section_no", "entry_no")) -> DataFrame:
    """Bullets of each entry with wrapped lines joined; bullet_no counts inside the entry."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("kind").isin("bullet", "para")
    b = bounded.filter(F.col("kind") != "header").withColumn("bullet_no", F.sum(own.cast("int")).over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "body"))), lambda s: s["body"]), " ")
    out = b.filter("bullet_no > 0").groupBy(*keys, "bullet_no").agg(text.alias("text"))
    return out.withColumn("has_metric", T.has_metric("text")).withColumn("n_words", T.count_words("text"))


def _segments_of(t: Column, date: Column) -> Column:
    """Header text without its date, cut at | and commas; a legal suffix stays with its company."""
    bare = F.when(date != "", F.replace(t, date, F.lit(" "))).otherwise(t)
    legal = r"(?i),\s*(" + "|".join(dims.LEGAL_SUFFIXES) + r")(\.?)(\s*,|\s*$)"
    out = F.transform(
        K.header_segments(bare),
        lambda s: F.transform(F.split(F.regexp_replace(s, legal, "\x01 $1$2$3"), ","), lambda p: F.trim(F.replace(p, F.lit("\x01"), F.lit(",")))),
    )
    return F.filter(F.flatten(out), lambda s: s != "")


def settle_entry(
    bounded: DataFrame,
    roles: Sequence[str] = tuple(dims.ROLE_WORDS),
    companies: Sequence[str] = tuple(dims.COMPANY_WORDS),
    places: Sequence[str] = tuple(dims.PLACES),
    keys: Sequence[str] = ("doc_id", "section_no", "entry_no"),
) -> DataFrame:
    """Role, company, location, dates and notes from the pooled header lines of each entry."""
    keys = list(keys)
    date = T.extract_date("body")
    head = bounded.withColumn("_date", F.when(F.col("kind") == "header", date).otherwise(""))
    pooled = head.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "header", F.struct("line_no", "body", "_date")))).alias("_h"),
        F.min_by(F.when(F.col("kind") == "header", F.nullif("_date", F.lit(""))),
                 F.when((F.col("kind") == "header") & (F.col("_date") != ""), F.col("line_no"))).alias("dates"),
        F.min_by(F.when(F.col("kind") == "bullet", F.col("body")), F.when(F.col("kind") == "bullet", F.col("line_no"))).alias("_fb"),
    )
    segs = F.flatten(F.transform("_h", lambda h: _segments_of(h["body"], h["_date"])))
    place = lambda s: K.looks_like_location(s, places)
    role = lambda s: K.looks_like_role(s, roles) & ~K.looks_like_company(s, companies)
    comp = lambda s: K.looks_like_company(s, companies)
    work = r"(?i)^(remote|hybrid|on-?site|contract|permanent|full[- ]time|part[- ]time|freelance|internship)$"
    tagged = F.transform(segs, lambda s, i: F.struct(
        i.alias("i"), s.alias("s"), s.rlike(work).alias("work"), place(s).alias("place"), role(s).alias("role"), comp(s).alias("comp")))
    first = lambda arr, cond: F.get(F.filter(arr, cond), F.lit(0))
    df = pooled.withColumn("_s", tagged)
    df = df.withColumn("_loc", first(F.col("_s"), lambda x: x["place"] & ~x["work"]))
    df = df.withColumn("_free", F.filter("_s", lambda x: ~x["work"] & ~x["i"].eqNullSafe(F.col("_loc.i"))))
    df = df.withColumn("_r0", first(F.col("_free"), lambda x: x["role"]))
    df = df.withColumn("_c0", first(F.col("_free"), lambda x: x["comp"] & ~x["i"].eqNullSafe(F.col("_r0.i"))))
    # the segment right behind the place is its region
    df = df.withColumn("_region", F.when(F.col("_loc").isNotNull(), first(
        F.col("_free"), lambda x: (x["i"] == F.col("_loc.i") + 1) & ~x["i"].eqNullSafe(F.col("_r0.i"))
        & ~x["i"].eqNullSafe(F.col("_c0.i")))))
    df = df.withColumn("_left", F.filter("_free", lambda x: ~x["i"].eqNullSafe(F.col("_region.i"))))
    df = df.withColumn("_r", F.coalesce("_r0", first(F.col("_left"), lambda x: ~x["i"].eqNullSafe(F.col("_c0.i")))))
    df = df.withColumn("_c", F.coalesce("_c0", first(F.col("_left"), lambda x: ~x["i"].eqNullSafe(F.col("_r.i")))))
    notes = F.filter("_s", lambda x: x["work"] | F.exists("_left", lambda y: (y["i"] == x["i"])
                     & ~y["i"].eqNullSafe(F.col("_r.i")) & ~y["i"].eqNullSafe(F.col("_c.i"))))
    years = T.date_years(F.coalesce("dates", F.lit("")))
    return df.select(
        *keys,
        F.coalesce("_r.s", F.lit("")).alias("role"),
        F.coalesce("_c.s", F.lit("")).alias("company"),
        F.coalesce(F.concat_ws(", ", "_loc.s", "_region.s"), F.lit("")).alias("location"),
        F.coalesce("dates", F.lit("")).alias("dates"),
        F.get(years, F.lit(0)).alias("start_year"),
        F.when(F.size(years) > 0, F.get(years, F.size(years) - 1)).alias("end_year"),
        T.is_current(F.coalesce("dates", F.lit(""))).alias("is_current"),
        F.array_join(F.array_distinct(F.transform(notes, lambda x: x["s"])), ", ").alias("notes"),
    )


def split_skills(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``Label: a, b / c`` -> one row per item with its group and label."""
    t = body_text()
    label, rest = F.trim(F.regexp_extract(t, SKILL_LABEL, 1)), F.trim(F.regexp_extract(t, SKILL_LABEL, 2))
    labelled = t.rlike(SKILL_LABEL) & (F.size(F.split(label, " ")) <= 4) & (rest != "") & (label != "")
    return lines.select(
        key,
        F.col("line_no").alias("group_no"),
        F.when(labelled, label).otherwise("").alias("label"),
        F.posexplode(split_list(F.when(labelled, rest).otherwise(t))).alias("item_no", "item"),
    )


def split_certs(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Listed credentials; a bare year belongs to the item before it."""
    items = lines.select(key, "line_no", F.posexplode(split_list(body_text())).alias("pos", "name"))
    w = Window.partitionBy(key).orderBy("line_no", "pos")
    own = F.nullif(F.regexp_extract("name", rf"(?:^|[^a-z0-9_])({fv.YEAR})(?:[^a-z0-9_]|$)", 1), F.lit(""))
    nxt = F.lead("name").over(w)
    return (
        items.withColumn("year", F.coalesce(own, F.when(nxt.rlike(YEAR_ONLY), F.trim(nxt)), F.lit("")))
        .filter(~F.col("name").rlike(YEAR_ONLY))
        .select(key, F.row_number().over(w).alias("item_no"), "name", "year")
    )


def split_languages(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``Name (level)``."""
    p = r"^(.*?)\s*\(([^)]{2,40})\)\s*$"
    items = lines.select(key, "line_no", F.posexplode(split_list(body_text())).alias("item_no", "part"))
    name = F.regexp_extract("part", p, 1)
    return items.select(
        key, "line_no", "item_no",
        F.when(name != "", name).otherwise(F.regexp_replace("part", r"\s*\([^)]{2,40}\)\s*$", "")).alias("name"),
        F.regexp_extract("part", p, 2).alias("level"))


def parse_education(
    lines: DataFrame, places: Sequence[str] = tuple(dims.PLACES), keys: Sequence[str] = ("doc_id", "section_no")
) -> DataFrame:
    """One entry per education section: degree, institution, dates, details.

    A date is cut out of the line, but a bare year stays in a name where a year has a segment of its own:
    ``University 1900 | 1996``.
    """
    keys = list(keys)
    t = body_text()
    date = T.extract_date(t)
    whole = K.header_segments(t)
    own = rf"^(?:\d{{1,2}}[/.\-])?{fv.YEAR}$"
    named = date.rlike(f"^{fv.YEAR}$") & F.exists(whole, lambda s: s.rlike(own))
    segs = F.when(named, F.filter(whole, lambda s: ~s.rlike(own))).otherwise(
        K.header_segments(F.when(date != "", F.replace(t, date, F.lit(" "))).otherwise(t)))
    rows = lines.withColumn("_t", t).withColumn("_d", date).withColumn(
        "_segs", F.filter(F.transform(segs, lambda s: F.regexp_replace(s, r"^[\s,-]+|[\s,-]+$", "")), lambda s: s != ""))
    x = rows.select(*keys, "line_no", "is_bullet", "_d", F.size("_segs").alias("_n"), F.posexplode_outer("_segs").alias("_i", "_seg"))
    at = F.struct("line_no", "_i")
    head = ~F.col("is_bullet") & F.col("_seg").isNotNull()
    degree = head & F.col("_seg").rlike(fv.DEGREE)
    school = head & F.col("_seg").rlike(fv.SCHOOL)
    other = head & ~degree & ~school & ~K.looks_like_location("_seg", places)
    pick = lambda cond: F.min_by(F.when(cond, F.col("_seg")), F.when(cond, at))
    agg = x.groupBy(*keys).agg(
        pick(degree).alias("_deg"), pick(school).alias("_school"), pick(other).alias("_other"),
        F.min_by(F.when(F.col("_d") != "", F.col("_d")), F.when(F.col("_d") != "", F.col("line_no"))).alias("dates"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("is_bullet") & (F.col("_i") == 0), F.struct("line_no", "_seg")))),
                                 lambda s: s["_seg"]), " | ").alias("details"))
    return agg.select(
        *keys, F.coalesce("_deg", F.when(F.col("_school").isNotNull(), F.col("_other")), F.lit("")).alias("degree"),
        F.coalesce("_school", F.when(F.col("_deg").isNotNull(), F.col("_other")), "_other", F.lit("")).alias("institution"),
        F.coalesce("dates", F.lit("")).alias("dates"), "details")


def parse_projects(lines: DataFrame, keys: Sequence[str] = ("doc_id", "section_no")) -> tuple[DataFrame, DataFrame]:
    """(projects, bullets): a plain line behind a bullet, or the first line, opens a project."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("line_no")
    t = body_text()
    opens = F.lag("line_no").over(w).isNull() | (~F.col("is_bullet") & F.lag("is_bullet").over(w))
    df = lines.withColumn("_t", t).withColumn("_o", opens)
    df = df.withColumn("project_no", F.sum(F.col("_o").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    date = T.extract_date("_t")
    head = df.filter(~F.col("is_bullet")).withColumn("_d", date)
    head = head.withColumn("_b", F.when(F.col("_d") != "", T.collapse_ws(F.replace(F.col("_t"), F.col("_d"), F.lit(" ")))).otherwise(F.col("_t")))
    segs = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "_b"))), lambda h: K.header_segments(h["_b"])))
    pk = [*keys, "project_no"]
    names = head.groupBy(*pk).agg(segs.alias("_s"), F.min_by(F.nullif("_d", F.lit("")), F.when(F.col("_d") != "", F.col("line_no"))).alias("dates"))
    at = lambda i: F.coalesce(F.get("_s", F.lit(i)), F.lit(""))
    bullets = df.filter("is_bullet").select(*pk, "line_no", F.col("_t").alias("text"))
    projects = df.select(*pk).distinct().join(names, pk, "left").select(
        *pk, at(0).alias("name"), at(1).alias("role"), F.coalesce("dates", F.lit("")).alias("dates"),
        F.array_join(F.filter(F.coalesce("_s", F.array().cast("array<string>")), lambda _, i: i >= 2), " | ").alias("detail"))
    return projects, bullets


def first_seen(df: DataFrame, keys: Sequence[Column | str], order: str) -> DataFrame:
    """Order-preserving distinct: the first row per key.

    An aggregate rather than a ranked window, so a key that holds a third of all
    rows is reduced map-side before the shuffle.
    """
    named = [T.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    best = df.select(*named, F.col(order).alias("_o"), F.struct(*df.columns).alias("_row"))
    return best.groupBy(*[f"_k{i}" for i in range(len(named))]).agg(F.min_by("_row", "_o").alias("_row")).select("_row.*")


def flatten_doc(parts: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """All parts of a document as one text; repeated parts (ignoring case) once, order kept."""
    kept = first_seen(parts.filter(F.trim("text") != ""), [key, F.lower(F.trim("text"))], order)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), F.trim("text").alias("t")))), lambda s: s["t"]), "\n")
    return kept.groupBy(key).agg(text.alias("text"))


def empty_docs(docs: DataFrame, *children: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents none of the child tables know."""
    out = docs
    for child in children:
        out = out.join(child.select(key).distinct(), key, "left_anti")
    return out


def drop_blank_rows(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    blank = F.lit(True)
    for f in fields:
        blank = blank & (F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "")
    return df.filter(~blank)


def column_mode(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Most frequent value per key; ties go to the one seen first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_p"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("_n", -F.col("_p"))).alias(value))


def layout_profile(blocks: DataFrame, key: str = "doc_id", order: str = "block_no") -> DataFrame:
    """Base, heading and name size, most frequent font / alignment / colour, tables and columns."""
    counts = blocks.groupBy(key).agg(
        F.count_if(F.col("kind") == "table").alias("n_tables"),
        F.max(F.coalesce(F.col("columns"), F.lit(1)) if "columns" in blocks.columns else F.lit(1)).alias("columns"))
    runs = L.running_sizes(blocks.filter((F.col("font_size") > 4) & (F.col("font_size") < 40)), [key], "font_size")
    w = Window.partitionBy(key)
    size, n = F.col("font_size"), F.col("n")
    runs = runs.withColumn("base_size", F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), size)).over(w))
    big = size > F.col("base_size") * 1.12
    below = F.sum(F.when(~big, n).otherwise(0)).over(w)  # sizes that are no headings come first in the running sum
    upper = (F.col("upto") - below) > F.floor((F.col("total") - below) / 2)
    sizes = runs.withColumn("_upper", upper).groupBy(key, "base_size").agg(
        F.coalesce(F.min(F.when(big & F.col("_upper"), size)), F.col("base_size") * 1.14).alias("heading_size"),
        F.coalesce(F.max(F.when(size > F.col("base_size") * 1.45, size)), F.col("base_size") * 2.1).alias("name_size"))
    out = counts.join(sizes, key, "left")
    for c in ("font", "align", "color"):
        if c in blocks.columns:
            out = out.join(column_mode(blocks, key, c, order), key, "left")
    return out


def text_layout(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tables, columns) of plain text: blocks of lines with two or more bars, and the most parts that wide gaps split three lines or more into.

    Worked out inside the row; a null text has neither.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")
    barred = lambda s: F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) >= 2
    rows = docs.select(key, lines.alias("_l"))
    starts = F.filter("_l", lambda s, i: barred(s) & ((i == 0) | ~F.coalesce(barred(F.get("_l", i - 1)), F.lit(False))))
    parts = F.transform("_l", lambda s: F.size(F.split(F.trim(s), r" {4,}|\t+")))
    wide = F.sort_array(F.filter(parts, lambda n: n > 1), asc=False)
    return rows.select(key, F.size(starts).alias("n_tables"), F.coalesce(F.get(wide, F.lit(2)), F.lit(1)).alias("columns"))
