"""Chunk fetch and context assembly (survey F6-F11).

The top-k table has at most ``k`` rows per question; callers write it once.
No side of the lookup is forced into a broadcast: Spark takes one only when the
written size is under the session's threshold, and joins by shuffle otherwise.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------
MAX_CTX_CHARS = 1400
MIN_PIECE_CHARS = 200
PIECE_SEP = "\n\n"
TITLE_SEP = ": "
# ---------------------------------------------------------------------------


def piece_length(k: int, max_ctx: int = MAX_CTX_CHARS) -> int:
    """characters per retrieved piece (466 at k=3, 200 at k=10)."""
    return max(MIN_PIECE_CHARS, max_ctx // max(1, k))


def fetch_chunks(top: DataFrame, chunks: DataFrame, keys=("doc_id", "pos")) -> DataFrame:
    """attach ``title, text`` to each retrieved id; unknown ids get ``''``."""
    keys = list(keys)
    wanted = top.select(*keys).distinct()
    found = chunks.select(*keys, "title", "text").join(wanted, keys, "left_semi")
    out = top.join(found, keys, "left")
    return out.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))


def trim_piece(k: int, max_ctx: int = MAX_CTX_CHARS, with_title: bool = True):
    """F7 as a Column: stripped text cut to the piece length, ``title: `` prefix when titled."""
    per = piece_length(k, max_ctx)
    body = F.substring(strip(F.col("text")), 1, per)
    piece = F.when(F.col("title") != "", F.concat(F.col("title"), F.lit(TITLE_SEP), body)).otherwise(body) if with_title else body
    return F.when(F.length("text") > 0, piece)


def build_context(fetched: DataFrame, q_ids=("qid",), k: int = 3, max_ctx: int = MAX_CTX_CHARS) -> DataFrame:
    """F8 (+G1): one row per question: best score, ordered scores and ids, context string."""
    q_ids = list(q_ids)
    items = fetched.select(
        *q_ids,
        F.struct("rank", trim_piece(k, max_ctx).alias("piece"), "score", "doc_id", "pos").alias("it"),
    )
    g = items.groupBy(*q_ids).agg(F.array_sort(F.collect_list("it")).alias("items"))
    ctx = F.substring(F.array_join(F.transform("items", lambda x: x["piece"]), PIECE_SEP), 1, max_ctx)
    return g.select(
        *q_ids,
        F.array_max(F.transform("items", lambda x: x["score"])).alias("best_score"),
        F.transform("items", lambda x: x["score"]).alias("scores"),
        F.transform("items", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["pos"].alias("pos"))).alias("ids"),
        ctx.alias("ctx"),
    )


def build_context_basic(fetched: DataFrame, q_ids=("qid",), k: int = 3, max_ctx: int = MAX_CTX_CHARS) -> DataFrame:
    """notebook variant, no titles, empty pieces kept, no final cut."""
    q_ids = list(q_ids)
    per = piece_length(k, max_ctx)
    items = fetched.select(*q_ids, F.struct("rank", F.substring(F.coalesce("text", F.lit("")), 1, per).alias("piece")).alias("it"))
    g = items.groupBy(*q_ids).agg(F.array_sort(F.collect_list("it")).alias("items"))
    return g.select(*q_ids, F.array_join(F.transform("items", lambda x: x["piece"]), PIECE_SEP).alias("ctx"))
