"""A training-corpus pipeline: five stages from raw documents to shuffled shards.

Each stage takes what the one before kept, as a table read from Parquet, and all but the last return the
columns of ``documents``, extra ones too, as they are.  Null ids, texts and sources, repeated rows and
ids, very long texts and empty tables are handled as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import catalog, decontam, langid, mixing, ngram_join, sharding
from sensorloom.llm.common import BROADCAST_ROWS, materialise, table
from sensorloom.session import ship
from sensorloom.storage import drop_since, mark

#: Documents whose language is told with less than this posterior probability are rejected.
LEAST_LANGUAGE_SCORE = 0.4
SHARDS = 24


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and those whose language cannot be told."""
    ship(spark)
    found = langid.identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), catalog.language_model(docs), columns=["row"])
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of smallest id and text hash.

    A document is an id with a text: other texts of an id are judged by themselves, rows equal in
    both are one, of which the first by its other columns stays.  Rows without id or words are in no
    group and stay.
    """
    ship(spark)
    groups = ngram_join.jaccard_components(docs, keys=True).filter("doc_id is not null and n_shingles > 0")
    first = (F.col("component_id") == F.col("doc_id")) & (F.col("component_key") == F.col("text_key"))
    groups = materialise(groups.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), first.alias("first")), "groups")
    same = lambda side: F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    met = (F.col("id") == F.col("of_id")) & (F.col("key") == F.col("of_key"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    drop = materialise(groups.filter("not first").select("of_id", "of_key").distinct(), "groups-drop")
    kept = keyed.join(same(drop), met, "left_anti")
    again = materialise(groups.filter("first").groupBy("of_id", "of_key").count().filter("count > 1").select("of_id", "of_key"), "groups-again")
    if not again.isEmpty():
        repeated = kept.join(same(again), met, "left_semi").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row", "id", "key")
        kept = kept.join(same(again), met, "left_anti").unionByName(repeated)
    return kept.select("row.*")


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages by the contamination rule; an empty benchmark drops none."""
    ship(spark)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = decontam.find_benchmark(rows, table(spark, sf_dir, "benchmark"), columns=["row"])
    return found.filter(~F.col("contaminated")).select("row.*")


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; a null source is a source."""
    ship(spark)
    return mixing.mixed_copies(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, copies too, with their shard and place; ``shard`` and ``slot`` replace columns of that name."""
    ship(spark)
    return sharding.shuffle_into_shards(docs, SHARDS)


STAGES = [
    ("language_id", known_language),
    ("ngram_join", one_of_each_group),
    ("decontamination", free_of_benchmark),
    ("mixing", mixed_to_weights),
    ("sharding", in_shards),
]

#: SQL cannot express the language model, the copies or the shuffle.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        begun = mark()
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_since(spark, begun, docs)  # the stage's own tables have done their work
    return STAGES[-1][1](spark, docs, sf_dir)
