"""Question and document readers (survey A1-A11, A13).

Formats are chosen by lowercase suffix at plan-build time (A13).  Every CSV
column is read as a string (no inference).  Row identity is the position in
the input: ``with_position`` numbers rows in file order without a global sort
(per-split counts, one row per split reaches the driver).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .json_document import read_json_elements

BOM = "﻿"


def strip_bom(col) -> Column:
    """A10: remove a UTF-8 byte-order mark at the start."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, "^\\x{FEFF}", "")


def with_position(spark: SparkSession, df: DataFrame, name: str = "pos", keep: Column | None = None) -> DataFrame:
    """0-based position of each row in input order (files by path, splits by offset).

    ``_metadata`` gives the file and split start of every row; rows of a split
    are contiguous inside one task, so ``monotonically_increasing_id`` minus the
    split's first id is the row's index in its split.  Split sizes are counted
    (one row per split to the driver) and turned into offsets.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"))
    if keep is not None:  # numbered after the filter, so kept rows get dense positions
        tagged = tagged.filter(keep)
    tagged = tagged.withColumn("__m", F.monotonically_increasing_id())
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    tagged = tagged.checkpoint(eager=True)  # fixes ids before they are counted
    splits = tagged.groupBy("__f", "__b").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("m0")).collect()
    base, acc = [], 0
    for r in sorted(splits, key=lambda r: (r["__f"], r["__b"])):
        base.append((r["__f"], r["__b"], acc - r["m0"]))
        acc += r["n"]
    offsets = spark.createDataFrame(base, "__f string, __b long, __o long")
    out = tagged.join(F.broadcast(offsets), ["__f", "__b"])  # one row per split: bounded
    return out.withColumn(name, F.col("__m") + F.col("__o")).drop("__f", "__b", "__m", "__o")


def resolve_column(df: DataFrame, name: str | None) -> str:
    """The named column when present, else the first column."""
    return name if name and name in df.columns else df.columns[0]


def clean_rows(col) -> Column:
    """Stringify, NULL -> '', strip."""
    c = F.col(col) if isinstance(col, str) else col
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def _read_delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
            .option("sep", sep).option("inferSchema", False).csv(path))


def _suffix(path: str) -> str:
    import os

    return os.path.splitext(path.rstrip("/"))[1].lower()


def read_questions(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A1-A4: ``(qid, question)`` in input order, stripped, blank dropped; ``json_parts``: a folder of ``write_json_document``."""
    fmt = fmt or {".json": "json", ".jsonl": "jsonl", ".csv": "csv", ".tsv": "tsv"}.get(_suffix(path), "txt")
    if fmt in ("csv", "tsv"):
        df = _read_delimited(spark, path, "," if fmt == "csv" else "\t")
        col = resolve_column(df, "question")
        df = with_position(spark, df, "qid", keep=F.length(clean_rows(f"`{col}`")) > 0)
        out = df.select("qid", clean_rows(f"`{col}`").alias("question"))
    elif fmt == "json":
        out = _json_items(spark, path, "questions", question_item)
    elif fmt == "json_parts":
        out = read_json_elements(spark, path, "qid").select("qid", question_item(F.col("item")).alias("question"))
    elif fmt == "jsonl":
        item = question_item(F.try_parse_json(strip_bom("value")))
        raw = with_position(spark, spark.read.text(path), "qid", keep=F.length(item) > 0)
        out = raw.select("qid", item.alias("question"))
    else:
        line = strip(strip_bom("value"))
        raw = with_position(spark, spark.read.text(path), "qid", keep=F.length(line) > 0)
        out = raw.select("qid", line.alias("question"))
    return out.filter(F.length("question") > 0)


def question_item(v: Column) -> Column:
    """A1 item rule: string as is; object -> its ``question`` (else ''); other scalars as text."""
    kind = F.schema_of_variant(v)
    as_text = F.when(kind == "STRING", F.variant_get(v, "$", "string")).when(
        kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(v, "$.question", "string"), F.lit(""))
    ).when(kind.isin("NULL", "VOID"), F.lit("")).otherwise(F.to_json(v))
    return strip(F.coalesce(as_text, F.lit("")))


def _json_items(spark: SparkSession, path: str, key: str, item_fn) -> DataFrame:
    """One JSON document per file: a top-level array, or an object holding the array under ``key``.

    A single JSON document is one value; large inputs should use JSON Lines
    (``fmt='jsonl'``), which is split and read in parallel.
    """
    items = _numbered_items(spark, path, key, "qid")
    return items.select("qid", item_fn(F.col("item")).alias("question"))


def _numbered_items(spark: SparkSession, path: str, key: str, name: str) -> DataFrame:
    """Array items of one JSON document per file, numbered across the files in path order.

    A file that doesn't parse, is too large for one value or holds no array
    fails the job: nothing is dropped silently.
    """
    raw = spark.read.text(path, wholetext=True)
    v = F.try_parse_json(strip_bom("value"))
    arr = F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    bad = F.raise_error(F.concat(F.lit(f"not a JSON array or an object with '{key}' (or too large for one value): "),
                                 F.col("_metadata.file_path")))
    found = raw.select(F.col("_metadata.file_path").alias("__f"), F.coalesce(arr, bad.cast("array<variant>")).alias("arr"))
    sizes = sorted(tuple(r) for r in found.select("__f", F.size("arr")).collect())  # one row a file
    base, acc = [], 0
    for f, n in sizes:
        base.append((f, acc))
        acc += n
    offsets = spark.createDataFrame(base, "__f string, __o long")
    items = found.select("__f", F.posexplode("arr").alias("__i", "item"))
    return items.join(F.broadcast(offsets), "__f").select((F.col("__i") + F.col("__o")).alias(name), "item")


def document_item(v: Column, text_key: str, title_key: str) -> tuple[Column, Column]:
    kind = F.schema_of_variant(v)
    is_obj = kind.startswith("OBJECT")

    def field(k):
        s = F.try_variant_get(v, f"$.{k}", "string")
        return strip(F.coalesce(s, F.lit("")))

    return F.when(is_obj, field(title_key)), F.when(is_obj, field(text_key))


def read_documents(spark: SparkSession, path: str, fmt: str | None = None, text_column: str = "text",
                   title_column: str = "title") -> DataFrame:
    """``(doc_id, title, text)`` in input order; blank text dropped; ``json_parts``: a folder of ``write_json_document``."""
    fmt = fmt or {".json": "json", ".jsonl": "jsonl", ".csv": "csv", ".tsv": "tsv"}.get(_suffix(path), "txt")
    if fmt in ("csv", "tsv"):
        df = _read_delimited(spark, path, "," if fmt == "csv" else "\t")
        tcol = resolve_column(df, text_column)
        title = F.col(f"`{title_column}`") if title_column in df.columns else F.lit("")
        df = with_position(spark, df, "doc_id", keep=F.length(clean_rows(f"`{tcol}`")) > 0)
        out = df.select("doc_id", clean_rows(title).alias("title"), clean_rows(f"`{tcol}`").alias("text"))
    elif fmt in ("json", "json_parts"):
        items = _numbered_items(spark, path, "items", "doc_id") if fmt == "json" else read_json_elements(spark, path, "doc_id")
        title, text = document_item(F.col("item"), text_column, title_column)
        out = items.select("doc_id", title.alias("title"), text.alias("text")).filter(F.col("text").isNotNull())
    elif fmt == "jsonl":
        line = strip_bom("value")
        item = F.coalesce(F.try_parse_json(line), F.raise_error(F.concat(F.lit("not a JSON line: "), line)).cast("variant"))
        title, text = document_item(item, text_column, title_column)
        blank = F.length(strip(F.col("value"))) == 0
        raw = with_position(spark, spark.read.text(path), "doc_id", keep=~blank)
        out = raw.select("doc_id", title.alias("title"), text.alias("text")).filter(F.col("text").isNotNull())
    else:
        text = strip(strip_bom("value"))
        raw = with_position(spark, spark.read.text(path, wholetext=True), "doc_id", keep=F.length(text) > 0)
        out = raw.select("doc_id", F.lit("").alias("title"), text.alias("text"))
    return out.filter(F.length("text") > 0)


def adapt_dataset(df: DataFrame, text_column: str = "text", title_column: str | None = None,
                  order_by: str | None = None, limit: int | None = None) -> DataFrame:
    """``(text, title)`` from any table: the named column, else the first string
    value longer than 10 characters in schema order, else an error; optional first-``limit`` rows."""
    if text_column in df.columns:
        text = F.col(f"`{text_column}`").cast("string")
    else:
        strs = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        cands = [F.when(F.length(F.col(f"`{c}`")) > 10, F.col(f"`{c}`")) for c in strs]
        text = F.coalesce(*cands) if cands else F.lit(None).cast("string")
        text = F.coalesce(text, F.raise_error(F.lit(f"column '{text_column}' not found")).cast("string"))
    title = F.col(f"`{title_column}`").cast("string") if title_column and title_column in df.columns else F.lit("")
    out = df
    if limit is not None:
        out = out.orderBy(order_by or df.columns[0]).limit(limit)
    keep = [order_by] if order_by else []
    return out.select(*keep, text.alias("text"), F.coalesce(title, F.lit("")).alias("title"))
