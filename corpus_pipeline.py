"""A training-corpus pipeline over ``documents``: five stages, each one of the operators in ``lectern.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and gives the written table to the next
stage.  All stages but the last return the columns of ``documents``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, jaccard_join, language_id, packing, suffix_dedup
from lectern.llm.common import anti_join, materialise, prepare


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject."""
    prepare(spark)
    found = language_id.identify(docs, language_id.fit(docs), declared=language_id.markup_language(F.col("text")),
                                 host=F.col("source"))
    gone = materialise(found.filter("rejected").select(F.col("row_key").alias("_l_key")).distinct(), "rejected")
    keyed = docs.withColumn("_l_key", F.xxhash64("doc_id", "text"))
    return anti_join(keyed, gone, "_l_key").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of equal texts."""
    prepare(spark)
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group of near duplicates."""
    prepare(spark)
    found = jaccard_join.near_duplicates(docs)
    gone = materialise(found.filter("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return anti_join(docs, gone, "doc_id")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also start elsewhere (400 bytes or 50 words), and their new length."""
    prepare(spark)
    cut = suffix_dedup.strip_passages(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 4096 tokens."""
    prepare(spark)
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    packed = packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language), ("exact_dedup", exact), ("jaccard_join", near), ("suffix_dedup", repeats),
          ("best_fit_packing", pack)]

#: SQL can't express the language model, the byte windows or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
