"""Exact dedup by progressive refinement: length, prefix hash, full hash.

Two texts are equal when they are identical after every run of ASCII white
space became one space.  Lengths are grouped first, prefix hashes only within
lengths that repeat, and the whole text is hashed only for rows whose length
and prefix repeat.

Defined cases: a null text is the empty text (all empty texts are one group).
A null id sorts after every id.  Rows repeated with one id and equal text are
one group; exactly one of them stays.  Extra columns of the input are ignored
by ``groups`` and ``flags`` and carried by ``keep``.  An empty table gives an
empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ASCII_SPACE, in_bits, materialise, member_bits

#: Characters hashed in the second step.
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE + "+", " ")


def full_hash(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per text held by at least two rows.

    Returns (text_sha256, keep_id, group_size, n_same): the smallest id, the
    number of rows, and how many of them carry the smallest id itself.
    """
    spark = docs.sparkSession
    n = normalised(F.col(text))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), n.alias("t"))
    length = F.length("t")
    prefix = F.xxhash64(length, F.substring("t", 1, prefix_chars))

    # step 1: lengths; step 2: prefix hashes of rows whose length repeats
    signed = materialise(rows.select(length.cast("bigint").alias("len"), prefix.alias("prefix")), "dedup-signs")
    lengths = signed.groupBy("len").count().filter("count > 1")
    by_len = member_bits(lengths, "len")
    prefixes = (signed.filter(in_bits(spark, F.col("len"), by_len))
                .groupBy("len", "prefix").count().filter("count > 1"))
    # step 3: whole texts of the rows left; a row that the filter lets through by chance forms a group of one
    by_prefix = member_bits(prefixes, "prefix")
    return (rows.filter(in_bits(spark, prefix, by_prefix))
            .select("id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))
            .groupBy("text_sha256", "id").agg(F.count("*").alias("c"))
            .groupBy("text_sha256").agg(F.min("id").alias("keep_id"), F.sum("c").alias("group_size"),
                                        F.min_by("c", F.coalesce("id", F.lit((1 << 63) - 1))).alias("n_same"))
            .filter("group_size > 1"))


def flags(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    found = materialise(groups(docs, doc_id, text), "dedup-groups")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), full_hash(F.col(text)).alias("text_sha256"))
    joined = rows.join(found, "text_sha256", "left").withColumn("alone", F.col("group_size").isNull())
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = joined.filter(F.col("alone") | ~first | (F.col("n_same") == 1)).select(
        "doc_id", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("alone") | first).alias("kept"), "text_sha256")
    # the smallest id itself repeats: one of its rows stays
    again = found.filter("n_same > 1").select(
        F.col("keep_id").alias("doc_id"), "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_same"))).alias("i"), "text_sha256")
    return out.unionByName(again.select("doc_id", "keep_id", "group_size", (F.col("i") == 1).alias("kept"), "text_sha256"))


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    spark = docs.sparkSession
    found = materialise(groups(docs, doc_id, text), "dedup-groups")
    sha = "_l_sha"
    hashed = docs.withColumn(sha, full_hash(F.col(text)))
    # rows of repeated texts: only these are shuffled
    key = F.xxhash64(F.col(sha))
    bitmap = member_bits(found.select(F.xxhash64("text_sha256").alias("h")), "h")
    hit = in_bits(spark, key, bitmap)
    marks = found.select(F.col("text_sha256").alias(sha), F.col("keep_id").alias("_l_keep"), F.col("n_same").alias("_l_same"))
    joined = hashed.filter(hit).join(marks, sha, "left")
    first = F.col(doc_id).cast("bigint").eqNullSafe(F.col("_l_keep"))
    single = joined.filter(F.col("_l_same").isNull() | (first & (F.col("_l_same") == 1)))
    repeated = joined.filter(first & (F.col("_l_same") > 1)).dropDuplicates([sha])
    return hashed.filter(~hit).select(*docs.columns).unionByName(single.unionByName(repeated).select(*docs.columns))
