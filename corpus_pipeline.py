"""A training corpus from raw documents: quality, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.bpe import encode
from termloom.llm.common import shared_dir, stored, table
from termloom.llm.mixing import copies, mix, row_marks
from termloom.llm.quality import fit, score
from termloom.llm.secrets import bloom, filter_bits, passes, redacted, scan
from termloom.llm.similar import similar_groups

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, scores at least LEAST_SCORE."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, carry=COLUMNS, least=LEAST_SCORE).select(*COLUMNS)


NO_ID = 1 << 62


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8 or more): the one with the least doc_id.

    A row is named by its doc_id and the hash of its columns, so rows that repeat a doc_id with other texts are documents
    of their own; a null doc_id comes behind all others. Rows equal in all columns count once.
    """
    name = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(*COLUMNS).alias("hash"))
    named = docs.select(*COLUMNS, name.alias("_name"))
    groups = stored(similar_groups(named, "_name", "text").withColumnRenamed("_name", "name"), "groups")
    gone = stored(groups.where("name != component_id").select(F.col("name").alias("_name")).distinct(), "gone")
    # texts are moved only where a filter of the names that go may hold theirs
    bits = filter_bits(gone.count())
    may_go = passes(bloom(gone.select(F.xxhash64("_name").alias("key")), bits), bits, F.xxhash64("_name"))
    kept = named.where(~may_go).union(named.where(may_go).join(gone, "_name", "left_anti").select(*named.columns))
    n, d = groups.agg(F.count("name"), F.count_distinct("name")).first()
    if n != d:
        kept = kept.dropDuplicates(["_name"])
    return kept.select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind in angle brackets."""
    found = scan(docs.select(*COLUMNS), carry=COLUMNS)
    text = F.when(F.size("spans") > 0, redacted("text", "spans")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix takes: up to three rows each, or none."""
    plan = mix(docs)[1].select("group", "floor", "cut", "more", "less")
    marked = docs.select(*COLUMNS, *row_marks("doc_id", "text", "source")).join(plan, "group")
    times = marked.withColumn("times", copies()).where("times > 0")
    return times.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit) and the digest of the decoded text of every row."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = encode(docs, ["doc_id", "lang", "source"], "text", ranks, public_tokenizers.PATTERN, decoded="decoded")
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

ORACLE_SQL = None  # boosted trees, XXH64 fingerprints and BPE have no SQL form; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{i}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
