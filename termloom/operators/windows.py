"""Window helpers shared by the jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sticky_mode(df: DataFrame, key: str, order: str, cue: Column, name: str = "mode") -> DataFrame:
    """Carry the last non-null cue forward."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(cue, ignorenulls=True).over(w))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """First k rows per key (all, ranked, if k is None).  ``row_number() <= k`` becomes a group limit on
    each map task before the shuffle, so a hot key ships at most k rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def lookahead_header(lines: DataFrame, has_date: Column, keys: Sequence[str], order: str = "line_no") -> DataFrame:
    """Adds soon_date (a date on one of the next two lines) and next_short (next line short or a bullet)."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = lines.withColumn("_d", has_date)
    nxt = F.lead("text").over(w)
    soon = F.coalesce(F.lead("_d", 1).over(w), F.lit(False)) | F.coalesce(F.lead("_d", 2).over(w), F.lit(False))
    short = F.coalesce((F.length(nxt) <= 90) & ~nxt.rlike("[.!?]$"), F.lit(False)) | F.coalesce(F.lead("is_bullet").over(w), F.lit(False))
    return df.withColumn("soon_date", soon).withColumn("next_short", short).drop("_d")


def keep_last(revisions: DataFrame, k: int, key: str = "doc_id", order: Sequence[str] = ("ts", "version_id")) -> DataFrame:
    """Newest k versions per key; rank 1 is the current one."""
    out = top_k(revisions, [key], [F.desc(c) for c in order], k, "age")
    return out.withColumn("is_current", F.col("age") == 1)


def experience_span(entries: DataFrame, as_of: int, key: str = "doc_id") -> DataFrame:
    """Last year minus first year per document, and years from the first start to ``as_of`` (0..45)."""
    start = F.min("start_year")
    since = F.lit(as_of) - start
    last = F.max(F.coalesce("end_year", "start_year"))
    return entries.groupBy(key).agg(
        F.when(F.count("start_year") + F.count_if(F.col("end_year") != F.col("start_year")) >= 2, last - start).alias("span"),
        F.when(since.between(0, 45), since).alias("years"))


def current_role(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Role (else company) of the first entry marked present, else of the first entry."""
    name = F.coalesce(F.nullif("role", F.lit("")), F.nullif("company", F.lit("")), F.lit(""))
    return entries.groupBy(key).agg(F.min_by(name, F.struct((~F.col("is_current")).cast("int").alias("c"), "entry_no")).alias("role"))


def metric_first(bullets: DataFrame, keys: Sequence[str], order: str = "bullet_no") -> DataFrame:
    """Bullets with a metric first; the order inside both halves stays."""
    w = Window.partitionBy(*keys).orderBy(F.desc("has_metric"), order)
    return bullets.withColumn("position", F.row_number().over(w))


def weakest_component(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest component per key, the first one on ties."""
    return components.groupBy(*keys).agg(
        F.min_by("component", F.struct("value", "ord")).alias("component"), F.min("value").alias("value"))
