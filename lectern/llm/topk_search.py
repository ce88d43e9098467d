"""Exact top-k by inner product with MaxScore over integer vectors.

Dimensions are the query's terms and a shard of candidates holds their
postings.  A shard's rows are arranged in cells of alike vectors (halved at the
median of the widest term), and every cell knows each term's least and largest
component.  A query first meets the cell that promises it most; any other cell
is skipped where the sum of its term bounds can't reach the k-th best score so
far.  In a cell that is left the terms are split by their bounds: the essential
ones are traversed for all its candidates, a candidate whose partial score plus
the bounds of the other terms falls short is dropped, and the others are probed
term group by term group as long as they stay competitive.  Every shard returns
its k best per query and the shards' lists are merged.

Queries travel in blocks, candidates in shards, and blocks meet shards by an
equality join, so neither is collected.

Defined cases: vectors that are null or empty, hold a null or a non-finite
component, or have a null id take no part.  Vectors of different length never
meet.  Rows that repeat an id are candidates each for itself, never of their
own id, and ask once.  Equal scores go to the smaller id.  Fewer than k
candidates give fewer rows.  Extra columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import map_rows

SCALE = 256
QUERY_BLOCK, SHARD, CELL, PROBE = 512, 4096, 128, 8
#: Bounds of the other terms together, as a share of the distance between threshold and least possible score.
SLACK = 0.15
#: Place of a score that isn't found yet.
NONE = -(1 << 63)


def usable(vec: Column) -> Column:
    x = vec.cast("array<double>")
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in doubles while every sum stays below 2**53, else in whole numbers, held to 64 bits."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a).dot(whole(b).T), NONE + 1, (1 << 63) - 1).astype(np.int64)


def arranged(c: np.ndarray) -> np.ndarray:
    """Order of a shard's rows in which every run of ``CELL`` rows is alike."""
    done, todo = [np.zeros(0, np.int64)], [np.arange(len(c))]
    while todo:
        at = todo.pop()
        if at.size <= CELL:
            done.append(at)
            continue
        half = max(CELL, at.size // 2 // CELL * CELL)
        term = c[at].std(0).argmax()
        cut = np.argpartition(c[at, term], half)
        todo += [at[cut[half:]], at[cut[:half]]]
    return np.concatenate(done)


class _Best:
    """The k best candidates of every query so far; equal scores go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.ident = np.full((n, k), NONE), np.full((n, k), (1 << 63) - 1)

    def limit(self) -> np.ndarray:
        """The k-th best score of every query, or minus infinity."""
        last = self.score[:, -1]
        return np.where(last == NONE, -np.inf, last)

    def admit(self, at: np.ndarray, ident: np.ndarray, score: np.ndarray) -> None:
        who, at = np.unique(at, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(who.size), self.k), at])
        ident = np.concatenate([self.ident[who].ravel(), ident])
        score = np.concatenate([self.score[who].ravel(), score])
        pick = np.lexsort((ident, ~score, at))  # ~x falls as x grows, and never overflows
        rank = np.arange(at.size) - np.searchsorted(at[pick], at[pick], side="left")
        pick = pick[rank < self.k]
        self.ident[who], self.score[who] = ident[pick].reshape(-1, self.k), score[pick].reshape(-1, self.k)


def best_in_shard(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int,
                  tally: dict | None = None) -> tuple[np.ndarray, ...]:
    """(query id, candidate id, score) of each query's k best candidates in the shard, in any order of its rows.

    ``tally`` takes the postings (query terms times candidates) that there are, and those that were read.
    """
    n, dims = q.shape
    best = _Best(n, k)
    starts = np.arange(0, c_id.size, CELL)
    read = 0

    if float(np.abs(q).max()) * float(np.abs(c).max()) * dims >= 2 ** 53:  # bounds in doubles would not be exact
        for a in starts:
            score, ident = _product(q, c[a:a + CELL]), c_id[a:a + CELL]
            at, j = np.nonzero((q_id[:, None] != ident[None, :]) & (score >= best.score[:, -1:]))
            best.admit(at, ident[j], score[at, j])
        read, starts = q.size * c_id.size, starts[:0]
    low, high = (f.reduceat(c, starts, 0) if starts.size else c[:0] for f in (np.minimum, np.maximum))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T  # bounds of a query's score in a cell

    def visit(cell: int, who: np.ndarray, limit: np.ndarray) -> int:
        a = starts[cell]
        part, ident = c[a:a + CELL], c_id[a:a + CELL]
        bound = up[who] * high[cell] + down[who] * low[cell]
        spread = np.abs(q[who]) * (high[cell] - low[cell])
        lead = np.argsort(-spread.sum(0), kind="stable")  # strongest term first
        behind = spread[:, lead[::-1]].cumsum(1)[:, ::-1]  # what the terms from one on can still decide
        room = np.where(np.isneginf(limit), 0, np.maximum(limit - least[who, cell], 0)) * SLACK
        essential = int((behind > room[:, None]).sum(1).max())
        first = lead[:essential]
        partial = q[np.ix_(who, first)] @ part[:, first].T
        rest = bound[:, lead[essential:]].sum(1)
        at, j = np.nonzero(partial + rest[:, None] >= limit[:, None])
        score, rest, reads = partial[at, j], rest[at], essential * partial.size
        for s in range(essential, dims, PROBE):  # probe while competitive
            terms = lead[s:s + PROBE]
            reads += at.size * terms.size
            score = score + (q[np.ix_(who[at], terms)] * part[np.ix_(j, terms)]).sum(1)
            rest = rest - bound[np.ix_(at, terms)].sum(1)
            ok = score + rest >= limit[at]
            at, j, score, rest = at[ok], j[ok], score[ok], rest[ok]
        ok = q_id[who[at]] != ident[j]
        best.admit(who[at[ok]], ident[j[ok]], score[ok].astype(np.int64))
        return reads

    promising = most.argmax(1) if starts.size else np.zeros(n, np.int64)
    for cell in range(starts.size):
        who = np.flatnonzero(promising == cell)
        if who.size:
            read += visit(cell, who, best.limit()[who])
    for cell in np.argsort(-most.max(0), kind="stable").tolist():
        limit = best.limit()
        who = np.flatnonzero((promising != cell) & (most[:, cell] >= limit))
        if who.size:
            read += visit(cell, who, limit[who])
    if tally is not None:
        tally["postings"] = tally.get("postings", 0) + q.size * c_id.size
        tally["read"] = tally.get("read", 0) + read
    at, place = np.nonzero(best.score != NONE)
    return q_id[at], best.ident[at, place], best.score[at, place]


def _blocks(rows: DataFrame, size: int, arrange: bool = False) -> DataFrame:
    """(block, dims, ids, body): up to ``size`` vectors of one length as binary, block numbers of their own."""
    def run(batches):
        part = TaskContext.get().partitionId()
        count, waiting = 0, {}

        def emit(dims, ids, body):
            nonlocal count
            count += 1
            ids, body = np.concatenate(ids), np.concatenate(body)
            if arrange:
                order = arranged(body)
                ids, body = ids[order], body[order]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + count]), pa.array([dims], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([body.tobytes()], pa.binary())], ["block", "dims", "ids", "body"])

        for b in batches:
            lists = b.column("vec")
            sizes = pa.compute.list_value_length(lists).to_numpy()
            values = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
            ends = np.cumsum(sizes)
            ids = b.column("id").to_numpy()
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                body = values[(ends[at] - dims)[:, None] + np.arange(dims)]
                for a in range(0, at.size, size):
                    have = waiting.setdefault(dims, [[], [], 0])
                    have[0].append(ids[at[a:a + size]])
                    have[1].append(body[a:a + size])
                    have[2] += have[0][-1].size
                    if have[2] >= size:
                        yield emit(dims, *have[:2])
                        del waiting[dims]
        for dims, have in waiting.items():
            yield emit(dims, *have[:2])

    return rows.mapInArrow(run, "block long, dims int, ids binary, body binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every query."""
    def rows(df: DataFrame) -> DataFrame:
        return df.filter(usable(F.col(embedding)) & F.col(vec_id).isNotNull()).select(
            F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("vec"))

    asked = rows(queries).dropDuplicates(["id"])
    shards = _blocks(rows(vectors), SHARD, arrange=True).selectExpr("block AS shard", "dims", "ids AS c_ids", "body AS c_body")
    blocks = _blocks(asked, QUERY_BLOCK).selectExpr("block AS q_block", "dims AS q_dims", "ids AS q_ids", "body AS q_body")
    # blocks of equal length meet: one row a pair of blocks, never of vectors
    names = shards.select("shard", "dims").join(blocks.select("q_block", F.col("q_dims").alias("dims")), "dims")
    met = names.join(blocks.drop("q_dims"), "q_block").join(shards.drop("dims"), "shard")

    def run(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("dims", "q_ids", "q_body", "c_ids", "c_body")}
            mats = [np.frombuffer(row[c], np.float64).reshape(-1, row["dims"]) for c in ("q_body", "c_body")]
            ids = [np.frombuffer(row[c], np.int64) for c in ("q_ids", "c_ids")]
            found = best_in_shard(ids[0], mats[0], ids[1], mats[1], k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    near = map_rows(met.select("dims", "q_ids", "q_body", "c_ids", "c_body"), run,
                    "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
