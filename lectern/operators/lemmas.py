"""Lemmas shared by corpus and questions (survey B3, B5).

The memo is a folder of Parquet rows ``(form, lemma)``.  The user's lemmatiser
runs on distinct forms that the memo doesn't hold yet (an anti-join), once for
all, and its answers are appended.  Texts and term blocks then only join the memo.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text, tokens
from ..session import LARGE_ROWS, written
from .term_blocks import with_lemmas
from .token_blocks import block_forms, replaced, token_blocks

MEMO = "form string, lemma string"


@dataclass(frozen=True)
class Lemmas:
    """A memo folder and ``make``: called once a task, it returns a function from a list of forms to their lemmas."""

    path: str
    make: Callable[[], Callable[[list[str]], list[str]]]

    def memo(self, spark: SparkSession) -> DataFrame:
        spark.createDataFrame([], MEMO).write.mode("ignore").parquet(self.path)
        return spark.read.schema(MEMO).parquet(self.path)

    def learn(self, forms: DataFrame) -> DataFrame:
        """The memo, extended by the forms (form) that it lacks; two writers at once may both add a form, readers take one."""
        make, spark = self.make, forms.sparkSession

        def run(batches):
            import pyarrow as pa

            lemmatise = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                lemmatise = lemmatise or make()
                column = batch.column("form").to_pylist()
                found = [x if y is None else y for x, y in zip(column, lemmatise(column))]
                yield pa.RecordBatch.from_arrays([batch.column("form"), pa.array(found, pa.string())], ["form", "lemma"])

        unseen = forms.select("form").filter("form <> ''").distinct().join(self.memo(spark), "form", "left_anti")
        unseen.mapInArrow(run, MEMO).write.mode("append").parquet(self.path)
        return self.memo(spark)

    def of_blocks(self, blocks: DataFrame) -> DataFrame:
        """Term blocks over lemmas; the distinct terms of the blocks are learnt first."""
        blocks = written(blocks, "form-blocks", **LARGE_ROWS)  # read by both steps
        return with_lemmas(blocks, self.learn(blocks.select(F.explode("terms").alias("form"))))

    def of_texts(self, df: DataFrame, ids: list[str], text: str, out: str = "norm") -> DataFrame:
        """``(ids, out)``: normalised texts with every token replaced by its lemma; ``ids`` are unique and not null."""
        rows = token_blocks(df.select(*ids, tokens(normalize_text(text)).alias("forms")), ids, "forms")
        memo = self.learn(block_forms(rows).select("form")).groupBy("form").agg(F.min("lemma").alias("lemma"))
        return replaced(rows, memo, "lemmas").select(*ids, F.array_join(F.array_remove("lemmas", ""), " ").alias(out))
