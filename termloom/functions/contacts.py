"""Contact details of the header lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom import fixed_values as fv
from termloom.functions import terms as K


def contacts(header: DataFrame, heading_keys: Sequence[str], places: Sequence[str], key: str = "doc_id") -> DataFrame:
    """One row per document: first qualifying value per field over the header lines.

    ``min_by`` over (line, segment) keeps the first hit and combines map-side.
    """
    text = F.col("text")
    rows = header.select(
        key, "line_no", "is_bullet", text,
        F.posexplode(F.concat(F.array(text), F.transform(K.header_segments(text), lambda s: F.regexp_replace(
            s, r"^[|\x{2022}\x{2013}\x{2014}\s-]+|[|\x{2022}\x{2013}\x{2014}\s-]+$", "")))).alias("seg_no", "seg"))
    seg = F.col("seg")
    got = lambda p: F.nullif(F.regexp_extract(seg, p, 0), F.lit(""))
    email = F.regexp_replace(got(fv.EMAIL), "[.,;]+$", "")
    linked = F.regexp_replace(got(fv.LINKEDIN), "[.,;)]+$", "")
    site = got(fv.PORTFOLIO)
    site = F.when(email.isNull() & ~F.lower(site).contains("linkedin"), F.regexp_replace(site, "[.,;)]+$", ""))
    phone = F.trim(got(fv.PHONE))
    digits = F.length(F.regexp_replace(phone, "[^0-9]", ""))
    phone = F.when(digits.between(8, 15), phone)
    place = F.when((F.length(seg) <= 40) & K.looks_like_location(seg, places), seg)
    heading = F.lower(F.trim(F.regexp_replace(text, r"[:._|*#-]+", " ")))
    is_name = (
        (F.col("seg_no") == 0) & ~F.col("is_bullet") & ~text.rlike(fv.EMAIL) & ~text.rlike(fv.LINKEDIN)
        & ~text.rlike(fv.PORTFOLIO)
        & ~(text.rlike(fv.PHONE) & (F.length(F.regexp_replace(text, "[^0-9]", "")) >= 8))
        & ~heading.isin(list(heading_keys)) & (F.size(F.split(text, " ")) <= 6)
        & ~text.rlike(r"(?i)resume|curriculum vitae|(^|[^a-z0-9_])cv([^a-z0-9_]|$)")
        & (F.length(F.regexp_replace(text, "[^A-Za-z]", "")) >= 3)
    )
    at = F.struct("line_no", "seg_no")
    first = lambda v: F.coalesce(F.min_by(v, F.when(v.isNotNull(), at)), F.lit(""))
    return rows.groupBy(key).agg(
        first(F.when(is_name, text)).alias("name"), first(email).alias("email"), first(phone).alias("phone"),
        first(linked).alias("linkedin"), first(site).alias("portfolio"), first(place).alias("location"))
