"""Document preparation and fixed-size overlapping chunks (survey E1, E2, A9).

Chunking is a narrow, per-row projection: one linear regex pass emits every
window (a lookahead captures ``size`` code points, the match then advances by
``step``), ``slice`` keeps the windows the reference loop would visit, and
``posexplode`` turns them into rows.  No Python, no shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------
CHUNK_SIZE = 700
CHUNK_OVERLAP = 120
MIN_CHUNK_CHARS = 20
# ---------------------------------------------------------------------------


def prepare_documents(df: DataFrame, text_col: str = "text", title_col: str | None = "source",
                      id_col: str = "doc_id") -> DataFrame:
    """A9 for documents: stringify, strip, blank text dropped, missing title -> ''."""
    title = strip(F.coalesce(F.col(title_col).cast("string"), F.lit(""))) if title_col and title_col in df.columns else F.lit("")
    text = strip(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), title.alias("title"), text.alias("text")).filter(
        F.length("text") > 0
    )


def window_count(length_col, size: int, step: int):
    """Index of the last window the reference loop visits: max(0, ceil((len-size)/step))."""
    return F.greatest(F.lit(0), F.ceil((length_col - F.lit(size)) / F.lit(step)))


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    min_chars: int = MIN_CHUNK_CHARS, keep_cols=("doc_id", "title")) -> DataFrame:
    """``(doc_id, title, text)`` -> ``(doc_id, title, pos, text)``, one row per kept window."""
    if size <= overlap:
        raise ValueError("chunk size must be greater than the overlap")
    step = size - overlap
    pattern = f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"
    windows = F.slice(
        F.regexp_extract_all(F.col("text"), F.lit(pattern), 1),
        1,
        (window_count(F.length("text"), size, step) + 1).cast("int"),
    )
    out = docs.select(*keep_cols, F.posexplode(windows).alias("pos", "raw"))
    return (
        out.select(*keep_cols, F.col("pos").cast("int").alias("pos"), strip(F.col("raw")).alias("text"))
        .filter(F.length("text") >= min_chars)
    )


#: Bytes of document text of a partition of clustered chunks: a task's term counts take some hundred MB.
PART_BYTES = 4 << 20


def cluster_parts(docs: DataFrame) -> int:
    """Partitions for the clustered chunks of ``docs``: at least the session's, else by the bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def cluster_chunks(chunks: DataFrame, parts: int | None = None) -> DataFrame:
    """Hash-cluster chunks by their key once.

    Every later per-chunk step (term counts, vector norm) groups by a superset
    of ``(doc_id, pos)`` and therefore runs without another exchange.  Keyed by the chunk, not the document, so one very long
    document spreads over many tasks.
    """
    return chunks.repartition("doc_id", "pos") if parts is None else chunks.repartition(parts, "doc_id", "pos")


def number_chunks(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """``chunk_id`` 0-based in ``(doc_id, pos)`` order, read off a written chunk store."""
    from ..session import scratch_path
    from ..sources.chunk_store import ChunkStore, write_chunk_store

    path = scratch_path(spark, "chunk-store")
    for c in ("title", "text"):
        chunks = chunks if c in chunks.columns else chunks.withColumn(c, F.lit(None).cast("string"))
    write_chunk_store(chunks, path)
    return ChunkStore(spark, path).numbered()
