"""Structuring jobs over stored documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom import dims
from termloom.operators import entries as E
from termloom.operators import lines as L
from termloom.plans import corpus as D
from termloom.plans.registry import query
from termloom.plans.text_jobs import _long
from termloom.sources import readers as R


def segmented(spark, sf):
    """Lines with their section, written once: sections, skills and locations all start here."""
    def build():
        lines = D.document_lines(spark, sf)
        # written, so that its size is known: a few headings are then no reason to shuffle all lines
        aliases = D.stored(spark, sf, "aliases", lambda: D.aliases_from_lines(lines))
        return L.segment_sections(lines, aliases, D.WEAK_HEADINGS)

    return D.stored(spark, sf, "segmented", build)


def page_lines(spark, sf):
    """Blocks of the stored pages as lines: list items are bullets, headings carry a size."""
    b = R.html_blocks(D.table(spark, sf, "pages"))
    return b.select(
        F.col("page_id").alias("doc_id"), F.col("block_no").alias("line_no"), "kind", "text", "heading_level",
        (F.col("kind") == "bullet").alias("is_bullet"), F.col("text").alias("bullet_text"))


@query
def to_lines(spark, sf):
    return D.document_lines(spark, sf).select("doc_id", _long("line_no"), "text", "is_bullet", "numbered")


@query
def heading_flag(spark, sf):
    lines = D.document_lines(spark, sf)
    h = L.heading_flag(lines, D.aliases_from_lines(lines))
    return h.filter("is_heading").select("doc_id", _long("line_no"), "heading_key")


@query
def section_lookup(spark, sf):
    lines = D.document_lines(spark, sf)
    keys = lines.filter(F.length("text") <= 64).select(L.normalize_heading("text").alias("heading_key")).filter("heading_key <> ''")
    return L.section_lookup(keys, D.aliases_from_lines(lines))


@query
def segment_sections(spark, sf):
    return segmented(spark, sf).select("doc_id", _long("line_no"), _long("section_no"), "section_id", "in_body")


@query
def section_table(spark, sf):
    s = L.sections(segmented(spark, sf))
    return s.select("doc_id", _long("section_no"), "section_id", "title", _long("first_line"), _long("line_count"))


@query
def join_wrapped_bullets(spark, sf):
    return L.join_wrapped_bullets(page_lines(spark, sf)).select("doc_id", _long("bullet_no"), "text", _long("n_lines"))


@query
def split_skills(spark, sf):
    return E.split_skills(D.document_lines(spark, sf)).select("doc_id", _long("group_no"), "label", _long("item_no"), "item")


def _header_table(spark, sf):
    """Role header rows of the orders table as lines of one section per customer."""
    d = D.dated_lines(spark, sf)
    bullet = F.col("o_orderkey") % 3 != 0
    return L.annotate_lines(d.select(
        F.col("o_custkey").alias("doc_id"), F.lit(1).alias("section_no"), F.col("o_orderkey").alias("line_no"),
        F.when(bullet, F.concat(F.lit("- Handled orders of "), "dates")).otherwise(F.col("line")).alias("text")))


@query
def entry_boundaries(spark, sf):
    return E.entry_boundaries(_header_table(spark, sf)).select("doc_id", _long("line_no"), _long("entry_no"), "kind")


@query
def settle_entry(spark, sf):
    e = E.settle_entry(E.entry_boundaries(_header_table(spark, sf)))
    return e.select("doc_id", _long("entry_no"), "role", "company", "location", "dates", _long("start_year"), _long("end_year"),
                    "is_current", "notes")


@query
def entry_bullets(spark, sf):
    b = E.entry_bullets(E.entry_boundaries(_header_table(spark, sf)))
    return b.select("doc_id", _long("entry_no"), _long("bullet_no"), "text", "has_metric", _long("n_words"))


@query
def split_certs(spark, sf):
    d = D.dated_lines(spark, sf).select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.lit(False).alias("is_bullet"),
        F.lit("").alias("bullet_text"),
        F.concat(F.lit("Course "), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(", "), F.substring("dates", -4, 4))).otherwise(F.lit(""))).alias("text"))
    return E.split_certs(d).select("doc_id", _long("item_no"), "name", "year")


@query
def split_languages(spark, sf):
    o = D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("line_no"), F.lit(False).alias("is_bullet"), F.lit("").alias("bullet_text"),
        F.concat(F.lit("Lang"), F.col("o_custkey"), F.lit(" ("), "o_orderpriority", F.lit("), plain")).alias("text"))
    return E.split_languages(o).select("doc_id", _long("item_no"), "name", "level")


@query
def parse_education(spark, sf):
    d = D.dated_lines(spark, sf).select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("section_no"), F.lit(0).alias("line_no"), F.lit(False).alias("is_bullet"),
        F.lit("").alias("bullet_text"),
        F.concat(F.lit("BSc Trade | University "), "o_custkey", F.lit(" | "), "dates").alias("text"))
    return E.parse_education(d).select("doc_id", "degree", "institution", "dates")


@query
def parse_projects(spark, sf):
    p, _ = E.parse_projects(page_lines(spark, sf).withColumn("section_no", F.lit(1)))
    return p.select("doc_id", _long("project_no"), "name")


@query
def dedupe_parsed(spark, sf):
    kept = E.first_seen(D.document_lines(spark, sf).select("doc_id", "line_no", "text"), ["doc_id", F.lower("text")], "line_no")
    return kept.select("doc_id", _long("line_no"), "text")


@query
def section_diagnostics(spark, sf):
    secs = L.sections(segmented(spark, sf))
    out = L.section_diagnostics(secs, dims.canonical_dim(spark), D.documents(spark, sf))
    return out.select("doc_id", "missing", _long("n_missing"))


@query
def present_sections(spark, sf):
    return L.present_sections(L.sections(segmented(spark, sf))).select("doc_id", "section_id", _long("position"))


@query
def empty_docs(spark, sf):
    s = segmented(spark, sf).filter(F.col("section_id").isin("summary", "experience", "education", "skills"))
    return E.empty_docs(D.documents(spark, sf).select("doc_id", "source"), s)


@query
def flatten_doc(spark, sf):
    return E.flatten_doc(D.document_lines(spark, sf).select("doc_id", "line_no", "text"))


@query
def layout_profile(spark, sf):
    b = page_lines(spark, sf).select(
        "doc_id", F.col("line_no").alias("block_no"), "kind",
        F.when(F.col("kind") == "heading", 24.0 - F.col("heading_level")).otherwise(10.0 + F.length("text") % 3).alias("font_size"),
        F.element_at(F.array(F.lit("left"), F.lit("center")), (F.length("text") % 2 + 1).cast("int")).alias("align"))
    p = E.layout_profile(b)
    return p.select("doc_id", "base_size", "heading_size", "name_size", "align", _long("n_tables"), _long("columns"))
