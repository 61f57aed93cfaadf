"""Landing documents, postings, pages and keyword strings as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import fixed_values as fv
from termloom.functions import text as T

BLOCK_TAGS = "h[1-6]|p|li|tr"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
# removed with their content before blocks are cut out
HTML_DROP = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
HTML_CELL = r"(?is)</t[dh]>\s*<t[dh][^>]*>"
HTML_OPEN = r"(?i)<(" + BLOCK_TAGS + r")(?:[^a-z0-9>][^>]*)?>"
HTML_CLOSE = r"(?i)</(?:" + BLOCK_TAGS + r")[^>]*>"


def read_docs(spark: SparkSession, path: str, fmt: str = "parquet", text_as_file: bool = False, partitions: int | None = None) -> DataFrame:
    """Already extracted text: a table, or one document per text file.

    ``partitions`` deals the rows over that many tasks, for a caller who knows that the files hold few splits.
    """
    if fmt == "text" and text_as_file:
        df = (
            spark.read.text(path, wholetext=True)
            .select(F.input_file_name().alias("source"), F.col("value").alias("text"))
            .select(F.xxhash64("source").alias("doc_id"), "text", "source")
        )
    else:
        df = spark.read.format(fmt).load(path)
    return df if partitions is None else df.repartition(partitions)


def triage_files(files: DataFrame) -> DataFrame:
    """Reason code per landed file (columns path, length, content of the binaryFile source)."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    head = F.hex(F.substring(F.col("content"), 1, 8))
    pdf, zipped, ole = (head.startswith(m) for m in (fv.PDF_MAGIC_HEX, fv.ZIP_MAGIC_HEX, fv.OLE_MAGIC_HEX))
    size = F.col("length")
    code = (
        F.when(~ext.isin(fv.SUPPORTED_EXTENSIONS), "unsupported-format")
        .when(size == 0, "empty-file")
        .when(size < fv.MIN_FILE_BYTES, "file-too-small")
        .when(size > fv.MAX_FILE_BYTES, "file-too-large")
        .when((ext == "pdf") & ~pdf & zipped, "wrong-format")
        .when((ext == "pdf") & ~pdf, "corrupt-pdf")
        .when((ext == "docx") & pdf, "wrong-format")
        .when((ext == "docx") & ole, "legacy-doc")
        .when((ext == "docx") & ~zipped, "corrupt-docx")
        .otherwise("ok")
    )
    return files.select("path", ext.alias("ext"), size.alias("length"), code.alias("code"))


def read_binary_files(spark: SparkSession, path: str, most: int = fv.MAX_FILE_BYTES) -> DataFrame:
    """path, length and content of landed files; content only up to `most` bytes, so that one huge file fails nothing.

    Listing reads no content: it is pruned from the first side, and the length filter reaches the scan of the second.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= most).select("path", "content")
    return files.select("path", "length").join(small, "path", "left")


def triage_code(text: Column | str, lo: int = fv.MIN_POSTING_CHARS, hi: int = fv.MAX_POSTING_CHARS) -> Column:
    n = F.length(F.regexp_replace(T.col(text), f"^{fv.WS}+|{fv.WS}+$", ""))
    return F.when(n == 0, "empty").when(n < lo, "short").when(n > hi, "too-long").otherwise("ok")


def triage_text(df: DataFrame, lo: int = fv.MIN_POSTING_CHARS, hi: int = fv.MAX_POSTING_CHARS) -> DataFrame:
    return df.withColumn("code", triage_code("text", lo, hi))


def flag_no_text(df: DataFrame, min_chars: int = fv.MIN_TEXT_CHARS) -> DataFrame:
    return df.withColumn("no_text", F.length(F.regexp_replace("text", "[^a-zA-Z0-9]", "")) < min_chars)


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Ordered heading / paragraph / bullet / table-row blocks; unclosed tags end at the next block."""
    h = F.regexp_replace(html, "[\x01\x02]", "")
    h = F.regexp_replace(h, HTML_DROP, "")
    h = F.regexp_replace(h, HTML_CELL, " | ")
    h = F.regexp_replace(h, HTML_OPEN, "\x01$1\x02")
    h = F.regexp_replace(h, HTML_CLOSE, "\x01")

    def clean(piece: Column) -> Column:
        t = F.regexp_replace(F.substring_index(piece, "\x02", -1), "<[^>]*>", "")
        for name, ch in ENTITIES:
            t = F.replace(t, F.lit(name), F.lit(ch))
        return T.collapse_ws(t)

    pieces = F.filter(F.split(h, "\x01"), lambda p: p.contains("\x02"))
    blocks = F.filter(
        F.transform(
            pieces, lambda p: F.struct(F.lower(F.substring_index(p, "\x02", 1)).alias("tag"), clean(p).alias("text"))
        ),
        lambda b: b["text"] != "",
    )
    kind = F.when(F.col("b.tag").startswith("h"), "heading").when(F.col("b.tag") == "li", "bullet").when(
        F.col("b.tag") == "tr", "table").otherwise("paragraph")
    return pages.select(key, F.posexplode(blocks).alias("block_no", "b")).select(
        key,
        "block_no",
        kind.alias("kind"),
        F.when(F.col("b.tag").startswith("h"), F.substring("b.tag", 2, 1).cast("int")).otherwise(0).alias("heading_level"),
        F.col("b.text").alias("text"),
    )


def keyword_table(df: DataFrame, key: str, raw: str, max_chars: int | None = None) -> DataFrame:
    """User keyword strings -> one row per keyword, first spelling wins within a key.

    ``min_by`` instead of a ranked window: it combines map-side, so a key that
    owns a third of all keywords still reaches the reducer as few rows.
    """
    part = F.regexp_replace(F.trim("part"), r"^[-*\x{2022}]\s*", "")
    return (
        df.select(key, F.posexplode(F.split(F.col(raw), r"[,;|\n\r\t]+")).alias("pos", "part"))
        .select(key, "pos", T.collapse_ws(part).alias("keyword"))
        .filter((F.length("keyword") >= 1) & (F.length("keyword") <= max_chars if max_chars else F.lit(True)))
        .groupBy(key, F.lower("keyword").alias("keyword_key"))
        .agg(F.min_by("keyword", "pos").alias("keyword"), F.min("pos").alias("pos"))
    )
