"""One JSON document of any size, as ordered part files (survey A12, A17, A18).

``["a1", "a2", ...]`` and ``{"items": [...]}`` are written as

* ``start``: the opening, ``end``: the closing bracket, one file each;
* ``body``: the elements in key order, one a line, range sorted into files;
  every element but the first of all has its comma in front;
* ``manifest``: rows (ordinal, file, bytes).

The files of the manifest, one behind the other, are the document.  Nothing is
grouped or gathered; the body is read back in parallel.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "ordinal int, file string, bytes long"


def write_json_document(rows: DataFrame, path: str, order: list[str], item: Column, key: str | None = None, parts: int | None = None) -> None:
    """``item``: the JSON text of a row, a single line (as ``to_json`` gives it); ``key``: the array is the value of this key."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.select(*order, item.alias("__item")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the first partition of a range sort holds the smallest keys, so the first row of all has the id 0
    numbered = sorted_rows.withColumn("__id", F.monotonically_increasing_id())
    seen = Observation()
    counted = numbered.observe(seen, F.count(F.lit(1)).alias("n"), F.min("__id").alias("first"))
    lines = counted.select(F.concat(F.when(F.col("__id") > 0, F.lit(",")).otherwise(F.lit("")), F.col("__item")).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/body")
    if seen.get["n"] and seen.get["first"] != 0:
        raise RuntimeError(f"the first partition of {path} is empty")
    brackets = spark.range(1)
    opening, closing = ("[", "]") if key is None else ('{"%s": [' % key, "]}")
    for name, text in (("start", opening), ("end", closing)):
        brackets.select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    found = None
    for i, name in enumerate(("start", "body", "end")):
        # names and sizes alone: file contents are not read
        files = spark.read.format("binaryFile").load(f"{path}/{name}").select(F.lit(i).alias("i"), F.col("path").alias("file"), F.col("length").alias("bytes"))
        found = files if found is None else found.unionByName(files)
    found = found.filter("bytes > 0").withColumn("name", F.substring_index("file", "/", -1))
    # one row a file
    ordinal = F.row_number().over(Window.orderBy("i", "name")) - 1
    relative = F.concat(F.element_at(F.array(F.lit("start"), F.lit("body"), F.lit("end")), F.col("i") + 1), F.lit("/"), F.col("name"))
    found.select(ordinal.alias("ordinal"), relative.alias("file"), "bytes").write.mode("overwrite").json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def read_json_elements(spark: SparkSession, path: str, name: str = "pos") -> DataFrame:
    """(pos, item): the elements as variants with their position; a line that isn't JSON fails the job."""
    from .readers import with_position

    raw = with_position(spark, spark.read.text(f"{path}/body"), name)
    text = F.regexp_replace("value", "^,", "")
    bad = F.raise_error(F.concat(F.lit("not a JSON element: "), text)).cast("variant")
    return raw.select(name, F.coalesce(F.try_parse_json(text), bad).alias("item"))
