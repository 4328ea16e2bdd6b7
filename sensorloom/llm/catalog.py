"""One query per operator over its whole table, with production parameters; SQL where it can tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import decontam, langid, licenses, media, mixing, ngram_join, oracles, sharding, substring, tokens, toxicity
from sensorloom.llm.common import table

TOKEN_LIMIT = 4096


def held_out(id_col: str = "doc_id") -> Column:
    """One id in five, by checksum; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), links=True)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_digest(sharding.shuffle_into_shards(docs, 24))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs, ~held_out(), sample_by=F.col("doc_id"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), language_model(docs), columns=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.media_columns(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.score_toxicity(docs, grammar)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.contamination_digest(decontam.find_benchmark(docs, benchmark, columns=["doc_id"]))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.license_digest(licenses.scan_licenses(docs))


def queries():
    return {f.__name__: f for f in (op1_ngram_join, op2_substring_dedup, op3_token_counts, op4_sharding, op5_mixing, op6_language_id, op7_media, op8_toxicity, op9_decontamination, op10_licenses)}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
