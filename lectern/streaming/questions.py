"""Answering a stream of question files.

Each micro-batch of newly arrived question rows is answered with the same
batch plan (``answer_questions``).  An opened corpus (``open_corpus``) is read
from its store; one from ``build_corpus`` is built again for every batch.  The
answers of an epoch overwrite the folder of that epoch, so an epoch that is
replayed after a failure leaves its rows once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.answer import Corpus, Options, answer_questions


def answer_stream(spark: SparkSession, questions_dir: str, corpus: Corpus, out_dir: str, checkpoint_dir: str,
                  opts: Options = Options(), trigger_once: bool = True):
    """Start a query that answers JSON Lines question files ``{"qid": ..., "question": ...}`` as they arrive."""
    stream = spark.readStream.schema("qid long, question string").json(questions_dir)

    def answer_batch(batch: DataFrame, epoch: int) -> None:
        qs = batch.select("qid", F.coalesce("question", F.lit("")).alias("question")).filter(F.length("question") > 0)
        answer_questions(qs, corpus, opts).write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(answer_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if trigger_once else writer
    return writer.start()
