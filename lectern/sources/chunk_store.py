"""The chunk store (survey A14, E2, F6): chunks in key order, numbered and fetched without a second copy.

Layout: ``rows/part=K`` holds the chunks of one key range, sorted by
``(doc_id, pos)``; ``files`` holds a row for each file: its first key, its
rows and how many rows come before it.

* A chunk's number is the rows before its file plus its row in the file
  (``_metadata.row_index``).  Reading needs no sort, no copy and no map of the
  driver.
* A fetch finds the ranges of the wanted keys and joins on the range first, so
  Spark prunes the directories at run time where it broadcasts the keys; no
  chunk is shuffled then.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILES = "file string, part int, doc_id long, pos int, n long, before long"


def write_chunk_store(chunks: DataFrame, path: str, parts: int | None = None) -> None:
    """``(doc_id, pos, title, text)`` in key order under ``path``, and the table of its files."""
    spark = chunks.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.select("doc_id", "pos", "title", "text").repartitionByRange(parts, "doc_id", "pos")
    rows = rows.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "doc_id", "pos")
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    found = (_rows(spark, path).groupBy(F.col("_metadata.file_name").alias("file"), "part")
             .agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n")))
    # one row a file
    before = F.sum("n").over(Window.orderBy("first.doc_id", "first.pos", "file").rowsBetween(Window.unboundedPreceding, -1))
    files = found.select("file", "part", "first.doc_id", "first.pos", "n", F.coalesce(before, F.lit(0)).alias("before"))
    files.write.mode("overwrite").parquet(f"{path}/files")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, pos int, title string, text string, part int").parquet(f"{path}/rows")


@dataclass
class ChunkStore:
    """An opened store."""

    spark: SparkSession
    path: str

    def files(self) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(f"{self.path}/files")

    def rows(self) -> DataFrame:
        """(part, doc_id, pos, title, text)."""
        return _rows(self.spark, self.path)

    def numbered(self) -> DataFrame:
        """Rows with ``chunk_id``, 0-based in key order."""
        rows = self.rows().select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
        files = F.broadcast(self.files().select("file", "before"))  # one row a file
        return rows.join(files, "file").select((F.col("before") + F.col("at")).alias("chunk_id"), "part", "doc_id", "pos", "title", "text")

    def _ranges(self) -> list:
        """First key and first number of every part (one row a part)."""
        return self.files().groupBy("part").agg(F.min(F.struct("doc_id", "pos")).alias("key"), F.min("before").alias("before")).orderBy("key").collect()

    def fetch(self, wanted: DataFrame, by: str = "key") -> DataFrame:
        """``wanted`` with ``title, text`` (and key or number) of its chunks, ``''`` for unknown ones.

        ``by``: "key" (doc_id, pos) or "id" (chunk_id).  Every row of ``wanted`` stays.
        """
        ranges = self._ranges()
        keys = ["doc_id", "pos"] if by == "key" else ["chunk_id"]
        found = self.rows() if by == "key" else self.numbered()
        if ranges:
            if by == "key":
                starts = F.array(*[F.struct(F.lit(r["key"]["doc_id"]).cast("bigint").alias("doc_id"), F.lit(r["key"]["pos"]).cast("int").alias("pos"))
                                   for r in ranges])
                mine = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("pos").cast("int").alias("pos"))
            else:
                starts, mine = F.array(*[F.lit(r["before"]).cast("bigint") for r in ranges]), F.col("chunk_id")
            at = F.size(F.filter(starts, lambda x: x <= mine))
            parts = F.array(*[F.lit(r["part"]) for r in ranges])
            keyed = wanted.select(*keys).distinct().withColumn("part", F.element_at(parts, F.greatest(at, F.lit(1))))
        else:
            keyed = wanted.select(*keys).distinct().withColumn("part", F.lit(-1))
        # the comparison tells Spark that the keys are selective, so it prunes the parts at run time
        some = keyed.filter(F.col("part") >= 0)
        hit = found.join(some, ["part", *keys]).drop("part")
        out = wanted.join(hit, keys, "left")
        return out.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
