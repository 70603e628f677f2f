"""One query per training-data operator over the driver's tables, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import (
    contamination, language, lines, mixing, negatives, ngram_join, packing, quality, ranking, substrings,
    tokens, urls, vectors,
)
from auditloom.llm.worker import ready

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many go, and a checksum of what stays."""
    return lines.dedup_lines(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, vocabulary("piece_bpe_32k.model")).drop("text")


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    docs = read(spark, sf_dir, "documents")
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of the documents is held out of the training."""
    docs = read(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    model = language.fit(docs.filter(~held).select("doc_id", "lang", "text"))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.size("lang_spans").alias("n_spans"),
    )


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that a smaller document has."""
    return substrings.dedup_substrings(read(spark, sf_dir, "documents"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the verdict of the current policy for every document."""
    entries = quality.ledger(read(spark, sf_dir, "documents"))
    base = F.col("failed").bitwiseAND(F.lit(quality.mask(quality.BASE))) != 0
    return quality.apply_policy(entries, quality.POLICIES["v2"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "failed",
    )


@query
def op6_quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per policy and rule, how many documents fail it and how many only it rejects."""
    return quality.ablations(quality.ledger(read(spark, sf_dir, "documents")))


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's n-gram set and its component of near duplicates."""
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id"
    )


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


@query
def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of near duplicates of every vector."""
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


@query
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url; a page is labelled through the document its url names by number."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = read(spark, sf_dir, "labels")
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("label")
    )
    number = F.regexp_extract("url", r"://[^?#]*/([0-9]{1,18})", 1)
    numbered = pages.withColumn("doc_id", F.when(number != "", number.cast("long")))
    labelled = numbered.join(good, "doc_id", "left")
    return urls.judge(labelled, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "template", "purity"
    )


@query
def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a passage of a benchmark item, and those items."""
    return contamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item."""
    return ranking.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives for the positives of every fiftieth vector; every seventh has a wrong label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select(
        "vec_id", label.alias("label"), negatives.scaled(F.col("embedding"), 256).alias("v")
    )
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


from auditloom.llm.oracle import ORACLE  # noqa: E402, F401
