"""Helpers shared by the training-data operators.

Arrow batches are cut by bytes, a membership filter takes its bits from a count
of its members up to a stated bound (beyond it there is a plain join), and every
intermediate table is written to the cluster's shared folder.
"""
from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import ensure_checkpoint_dir, scratch_path, ship_package

#: ASCII white space as the contracts define it.
ASCII_SPACE = r"[\x20\x09-\x0D]"
#: Bits a member of a membership filter (two of them are set), and the bits it may have at least and at most
#: (16 MiB).  It only prunes, an exact join follows; with more members than ``FILTER_MOST`` bits there is no filter.
BITS_A_MEMBER, FILTER_LEAST, FILTER_MOST = 32, 1 << 20, 1 << 27
#: UTF-8 bytes of text handled at once inside a Python worker.
CHUNK_BYTES = 2 << 20
#: Rows of an Arrow batch, where the session sets none.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def prepare(spark: SparkSession) -> None:
    """Shared folder and package for the executors; safe to call repeatedly.

    Rows of long texts move to Python in small batches unless the session says otherwise.
    """
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str,
             by: str | None = None, chunk_bytes: int = CHUNK_BYTES, only=None,
             after: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` with batches cut so that column ``by`` holds about ``chunk_bytes``.

    ``only``: (column, broadcast bitmap or None); rows that the filter lacks are
    left out first, in the same worker.  ``after`` runs when a task has read its rows: it
    empties caches, as workers outlive their tasks.  Free memory then goes back
    to the system.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only is not None:
                batch = batch.filter(pa.array(may_be_in(only[1], batch.column(only[0]))))
            for piece in cut_batch(batch, by, chunk_bytes):
                yield from fn(piece)
        if after is not None:
            after()
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give a worker's free memory back to the system: workers are reused, and their heaps would only grow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def cut_batch(batch: pa.RecordBatch, by: str | None, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    if by is None or batch.num_rows == 0:
        if batch.num_rows:
            yield batch
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes.astype(np.int64) + 16) // chunk_bytes
    edges = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a binary column; null is empty, broken UTF-8 becomes U+FFFD."""
    return [b.decode("utf-8", "replace") if b else "" for b in column.to_pylist()]


def utf8(col: Column) -> Column:
    """The text's UTF-8 bytes, null as empty."""
    return F.coalesce(col.cast("binary"), F.lit(b""))


# --- membership filter -------------------------------------------------------

def _slots(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each value."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    y = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(17)) & np.uint64(bits - 1), (y >> np.uint64(23)) & np.uint64(bits - 1)


def member_bits(df: DataFrame, col: str, bits: int | None = None) -> np.ndarray | None:
    """A bitmap holding every value of a bigint column, sized by their number; None for too many of them.

    Each task marks its own bitmap; the bitmaps meet in a two-step OR, so what
    reaches the driver is about ``bits / 8`` bytes at most.
    """
    if bits is None:
        members = df.count()
        if members > FILTER_MOST:
            return None
        bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (BITS_A_MEMBER * members - 1).bit_length()))

    def mark(batches):
        seen = np.zeros(bits // 64, np.uint64)
        for b in batches:
            v = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            for slot in _slots(v.astype(np.int64), bits):
                np.bitwise_or.at(seen, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        at = np.flatnonzero(seen)
        if at.size:
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at].view(np.int64), pa.int64())], ["at", "word"])

    rows = (df.select(F.col(col).cast("bigint").alias("v")).mapInArrow(mark, "at long, word long")
            .groupBy("at").agg(F.bit_or("word").alias("word")).toPandas())
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows["at"].to_numpy(dtype=np.int64)] = rows["word"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


def may_be_in(shared, column: pa.Array) -> np.ndarray:
    """Rows of a bigint column that a broadcast filter may hold; null is no member."""
    some = column.is_valid().to_numpy(zero_copy_only=False)
    return some if shared.value is None else some & has_bits(shared.value, column.fill_null(0).to_numpy(zero_copy_only=False))


def has_bits(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    hits = [((bitmap[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) for s in _slots(values, bitmap.size * 8)]
    return hits[0] & hits[1]


def in_bits(spark: SparkSession, col: Column, bitmap: np.ndarray | None) -> Column:
    """Whether the filter may hold the value (never false for a member); null is no member.  Without a filter any value may be one."""
    if bitmap is None:
        return col.isNotNull()
    shared = spark.sparkContext.broadcast(bitmap)

    @F.arrow_udf(T.BooleanType())  # no pandas in the workers
    def test(v: pa.Array) -> pa.Array:
        return pa.array(may_be_in(shared, v))

    return test(col.cast("bigint"))


def semi_join(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose key is in ``ids``; only rows passing the filter are shuffled."""
    spark = docs.sparkSession
    hit = docs.filter(in_bits(spark, F.col(key), member_bits(ids, key)))
    return hit.join(ids.select(key).distinct(), key, "left_semi")


def anti_join(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose key isn't in ``ids`` (null keys stay)."""
    spark = docs.sparkSession
    hit = in_bits(spark, F.col(key), member_bits(ids, key))
    rest = docs.filter(hit).join(ids.select(key).distinct(), key, "left_anti")
    return docs.filter(~hit).unionByName(rest)


# --- connected components ----------------------------------------------------

def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of undirected ``edges`` (a bigint, b bigint).

    Returns (node, component): the smallest node reachable, for every node that
    has an edge.  Labels spread along the edges and then jump to their label's
    label, so a path of n nodes ends after about log n rounds.  Every join has
    written tables on both sides, which lets Spark split a hub's rows.
    """
    spark = edges.sparkSession
    both = materialise(edges.select("a", "b").filter("a <> b")
                       .unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a <> b"))
                       .distinct(), "edges")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                        .select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(rounds):
        near = (both.join(label.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m")))
        stepped = materialise(label.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "m").alias("component")), "labels")
        up = stepped.select(F.col("node").alias("component"), F.col("component").alias("up"))
        label2 = materialise(stepped.join(up, "component").select(
            "node", "was", F.least("up", "component").alias("component")), "labels")
        label = label2.select("node", "component")
        if label2.filter("component <> was").limit(1).count() == 0:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


# --- pair merging ------------------------------------------------------------

#: Rank of a pair that never merges.
NO_PAIR = 1 << 40


def rank_of_pairs(keys: np.ndarray, ranks: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each pair of ids by a sorted table of ``left << 24 | right``."""
    key = left << 24 | right
    at = np.minimum(np.searchsorted(keys, key), keys.size - 1)
    return np.where(keys[at] == key, ranks[at], NO_PAIR)


def merge_side_by_side(ids: np.ndarray, n: np.ndarray, pair_rank, token_of=None) -> list[list[int]]:
    """Merge the adjacent pair of lowest rank, leftmost among equals, in every row until none is left.

    ``ids``: rows of ``n`` ids with one spare column; ``token_of`` maps a rank to the merged id.
    """
    width = ids.shape[1] - 1
    col = np.arange(width)
    rank = np.where(col < n[:, None] - 1, pair_rank(ids[:, :-1], ids[:, 1:]), NO_PAIR)
    done, row = ids.copy(), np.arange(len(ids))
    while row.size:
        i = rank.argmin(1)
        every = np.arange(row.size)
        low = rank[every, i]
        more = low < NO_PAIR
        if not more.all():
            done[row[~more]] = ids[~more]
            row, ids, rank, i, low = row[more], ids[more], rank[more], i[more], low[more]
            every = np.arange(row.size)
            if not row.size:
                break
        n[row] -= 1
        ids[:, :-1] = np.take_along_axis(ids, np.minimum(col + (col > i[:, None]), width), 1)
        ids[every, i] = low if token_of is None else token_of[low]
        rank = np.take_along_axis(rank, np.minimum(col + (col >= i[:, None]), width - 1), 1)
        rank[:, -1] = NO_PAIR
        for j in (i, i - 1):
            ok = (j >= 0) & (j < n[row] - 1)
            rank[every[ok], j[ok]] = pair_rank(ids[every[ok], j[ok]], ids[every[ok], j[ok] + 1])
        last = i >= n[row] - 1
        rank[every[last], i[last]] = NO_PAIR
    return [r[:k] for r, k in zip(done.tolist(), n.tolist())]
