"""Answer, dataset and index sinks (survey A12, A15-A21).

Writers are distributed (one file per task); the order column is kept so
readers restore question order.  The one-document JSON forms of the reference
(``["a1", ...]``, ``{"items": [...]}``) are written as ordered parts with a
manifest (``json_document``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import REFUSE
from .json_document import write_json_document


#: Spark's CSV writer trims values unless told otherwise.
KEEP_BLANKS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
META_SCHEMA = "model string, dim long, chunks long, chunk_size int, chunk_overlap int"


def check_alignment(questions: DataFrame, answers: DataFrame, key: str = "qid") -> DataFrame:
    """Fails the job when questions and answers do not pair up 1:1; else one row of counts."""
    # rows per key on both sides; a key answered twice is a surplus answer without a question
    both = questions.select(key, F.lit(1).alias("__q"), F.lit(0).alias("__a")).unionByName(
        answers.select(key, F.lit(0).alias("__q"), F.lit(1).alias("__a")))
    j = both.groupBy(key).agg(F.sum("__q").alias("__q"), F.sum("__a").alias("__a"))
    stats = j.agg(F.coalesce(F.sum(F.greatest(F.col("__q") - F.col("__a"), F.lit(0))), F.lit(0)).alias("missing_answers"),
                  F.coalesce(F.sum(F.greatest(F.col("__a") - F.col("__q"), F.lit(0))), F.lit(0)).alias("missing_questions"),
                  F.coalesce(F.sum(F.least("__q", "__a")), F.lit(0)).alias("pairs"))
    bad = (F.col("missing_answers") > 0) | (F.col("missing_questions") > 0)
    return stats.withColumn("ok", F.when(bad, F.raise_error(F.lit("questions and answers must pair up"))).otherwise(F.lit(True)))


def write_answers(df: DataFrame, path: str, fmt: str = "json_pairs", key: str = "qid") -> None:
    """Answers in question order; ``fmt`` in json, json_pairs, csv, tsv."""
    fmt = fmt.lower()
    ordered = df.orderBy(key)
    if fmt == "json":
        ordered.select(key, F.coalesce("answer", F.lit(REFUSE)).alias("answer")).write.mode("overwrite").json(path)
    elif fmt == "json_pairs":
        ordered.select(key, "question", "answer").write.mode("overwrite").json(path)
    elif fmt in ("csv", "tsv"):
        (ordered.select("question", "answer").write.mode("overwrite").option("header", True).option("escape", '"')
         .options(**KEEP_BLANKS).option("sep", "," if fmt == "csv" else "\t").csv(path))
    else:
        raise ValueError(f"unknown answers format: {fmt}")


def _as_json(col: str) -> Column:
    """A string column as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(col, F.lit("")).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def write_answers_document(df: DataFrame, path: str, pairs: bool = False, key: str = "qid") -> None:
    """A17, A18 exact forms: one JSON array of answers, or of question and answer objects, in question order."""
    answer = F.coalesce("answer", F.lit(REFUSE))
    if pairs:
        item = F.to_json(F.struct(F.coalesce("question", F.lit("")).alias("question"), answer.alias("answer")))
        write_json_document(df, path, [key], item)
    else:
        write_json_document(df.withColumn("__answer", answer), path, [key], _as_json("__answer"))


def write_dataset_document(df: DataFrame, path: str, order: str) -> None:
    """A12 exact form: ``{"items": [{"text", "title"}, ...]}`` in the order of a column of ``df``."""
    write_json_document(df, path, [order], F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("title", F.lit("")).alias("title"))), "items")


def write_dataset(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Adapted ``(text, title)`` rows as JSON Lines, CSV or TSV."""
    fmt = fmt.lower()
    out = df.select("text", "title")
    if fmt == "json":
        out.write.mode("overwrite").json(path)
    elif fmt in ("csv", "tsv"):
        out.write.mode("overwrite").option("header", True).option("escape", '"').options(**KEEP_BLANKS).option(
            "sep", "," if fmt == "csv" else "\t").csv(path)
    else:
        raise ValueError(f"unknown dataset format: {fmt}; use json, csv or tsv")


def write_vector_store(vectors: DataFrame, path: str) -> None:
    """The exact flat store: one row per chunk with its terms and weights."""
    per_chunk = vectors.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("vec"))
    per_chunk.write.mode("overwrite").parquet(path)


def read_vector_store(spark: SparkSession, path: str) -> DataFrame:
    """A15 read: back to the long form ``(doc_id, pos, term, w)``."""
    return spark.read.parquet(path).select("doc_id", "pos", F.inline("vec"))


def index_meta(chunks: DataFrame, vectors: DataFrame, model: str, chunk_size: int, chunk_overlap: int) -> DataFrame:
    """One row ``(model, dim, chunks, chunk_size, chunk_overlap)``; ``dim`` is the vocabulary size."""
    parts = chunks.agg(F.count(F.lit(1)).alias("v")).select(F.lit("chunks").alias("k"), "v").unionByName(
        vectors.agg(F.countDistinct("term").alias("v")).select(F.lit("dim").alias("k"), "v"))
    return parts.agg(F.max(F.when(F.col("k") == "dim", F.col("v"))).cast("long").alias("dim"),
                     F.max(F.when(F.col("k") == "chunks", F.col("v"))).cast("long").alias("chunks")).select(
        F.lit(model).alias("model"), "dim", "chunks", F.lit(chunk_size).alias("chunk_size"),
        F.lit(chunk_overlap).alias("chunk_overlap"))
