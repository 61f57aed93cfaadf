"""Registered queries of the operators: thin calls with production parameters, and digests of their outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.mixing import copies, mix

    sizes, plan = mix(table(spark, sf_dir, "documents"))
    rows = sizes.select("key", "group", "size", "h").join(plan.select("group", "total", "target", "floor", "cut", "more", "less"), "group")
    return rows.select(F.col("key").alias("doc_id"), "size", F.col("total").alias("source_size"), "target", (copies() * F.col("size")).alias("taken"))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)


@query
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.htmlcrf import extract

    return extract(table(spark, sf_dir, "pages"), "html", ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.quality import fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op5_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.voronoi import quantised, top_k

    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantised("embedding").alias("whole"))
    return top_k(rows, "vec_id", "whole", k=10, query=F.col("vec_id") % 100 == 0)


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from termloom.llm.bpe import encode

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = encode(table(spark, sf_dir, "documents"), ["doc_id"], "text", ranks, public_tokenizers.PATTERN, decoded="decoded")
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.warc import archive_folder, read_archives, train_dictionary, with_owners, write_archives

    pages = table(spark, sf_dir, "pages")
    written = write_archives(with_owners(pages, "page_id", "html"), archive_folder(spark), train_dictionary(pages, "html"))
    return read_archives(written, with_payload=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.crosspolytope import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


@query
def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.secrets import BASE, has_kind, scan, span_list

    found = scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = [r.kind for r in BASE]
    counts = [F.size(F.filter("spans", has_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(span_list("spans", base), 256).alias("base_sha256"), span_list("spans").alias("spans"))


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"), dims=64, k=8, rounds=10, seed=3)


def with_repeats(docs: DataFrame) -> DataFrame:
    """The contract's texts: in those whose hash ends in 0, the words from a on repeat the p words at a."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    rows = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.when(F.size("w") > 0, F.size("w")))
    rows = rows.withColumn("a", F.col("g") % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda x: F.get("w", F.when(x < F.col("a"), x).otherwise(F.col("a") + (x - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(at, " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.runs import periodic_runs

    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")), exponent=4, least=6)
    best = F.expr("""aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>),
        (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))""")  # runs come by start, then period: the first of equals stays
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda d: d["base"])

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")

    score = F.coalesce(F.array_max(F.transform("found", lambda d: d["weight"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda d: d["start"])).alias("first_word"),
                        F.array_max(F.transform(base, lambda d: d["start"])).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"), score.alias("score"))
