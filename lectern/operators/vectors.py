"""Vectors, exact scoring and top-k (survey F1-F5).

Default encoder (no user model): bag-of-terms over ``normalize_lemma`` text,
term frequency, L2-normalised, long form ``(id..., term, w)``.  Inner product
of two such vectors is the cosine of their term-frequency vectors.

Scale notes
* The long form is built on chunk rows hash-clustered by ``(doc_id, pos)``: term
  counts and the norm window group by supersets of that key, so they add no
  exchange.  Scoring reads term blocks instead (``term_blocks``).
* Top-k uses ``row_number() <= k``; Catalyst inserts a partial
  ``WindowGroupLimit`` before the exchange, so only ``k`` rows per question per
  partition are shuffled.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, tokens
from ..session import scratch_path

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------
TOP_K = 3
# ---------------------------------------------------------------------------
SCORE_DIGITS = 9


def normalize_lemma(col, lemma_map: Column | None = None) -> Column:
    """Normalise, then lemmatise through a small map column if given."""
    n = normalize_text(col)
    if lemma_map is None:
        return n
    from ..functions.text import lemmatize_with_map

    return lemmatize_with_map(n, lemma_map)


def term_counts(df: DataFrame, ids: list[str], text_col: str, lemma_map: Column | None = None,
                lemma_table: DataFrame | None = None) -> DataFrame:
    """Token counts per id: ``(ids..., term, tf)``."""
    exploded = df.select(*ids, F.explode(tokens(normalize_lemma(text_col, lemma_map))).alias("term"))
    if lemma_table is not None:
        exploded = lemmatize_tokens(exploded, lemma_table)
    return exploded.groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("tf"))


def lemmatize_tokens(exploded: DataFrame, lemma_table: DataFrame) -> DataFrame:
    """B3/B4 (large lemma table): join distinct tokens to the table, unknown -> itself.

    The table is cut to the forms that occur (distinct tokens, a partial
    aggregate before the shuffle) and written once.  Both sides of the join are
    then plain shuffles: Spark broadcasts the written table when its size is
    under the session's threshold and splits the rows of a frequent token
    otherwise.
    """
    spark = exploded.sparkSession
    path = scratch_path(spark, "lemmas")
    lemmas = lemma_table.select(F.col("form").alias("term"), F.col("lemma")).dropDuplicates(["term"])
    lemmas.join(exploded.select("term").distinct(), "term").write.parquet(path)
    used = spark.read.schema("term string, lemma string").parquet(path)
    out = exploded.join(used, "term", "left")
    return out.withColumn("term", F.coalesce("lemma", "term")).drop("lemma")


def l2_weights(tf: DataFrame, ids: list[str]) -> DataFrame:
    """F1 on the long form: ``w = tf / sqrt(sum(tf^2))`` per id."""
    w = Window.partitionBy(*ids)
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(w))
    return tf.select(*ids, "term", (F.col("tf") / norm).alias("w"))


def encode_terms(df: DataFrame, ids: list[str], text_col: str, lemma_map: Column | None = None,
                 lemma_table: DataFrame | None = None) -> DataFrame:
    """F2 default: unit term-frequency vectors in long form ``(ids..., term, w)``."""
    return l2_weights(term_counts(df, ids, text_col, lemma_map, lemma_table), ids)


def l2_normalize(col) -> Column:
    """F1 for dense arrays: divide by the norm; a zero vector stays zero."""
    v = F.col(col) if isinstance(col, str) else col
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # the norm is bound once as the single element of an array, not evaluated again for each component
    scaled = F.transform(F.array(norm), lambda n: F.transform(
        v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))
    return F.get(scaled, 0)


def rank_top_k(scores: DataFrame, q_ids: list[str], tie: list[str], k: int = TOP_K) -> DataFrame:
    """best ``k`` per question by rounded score, lower chunk key first on ties."""
    ranked = scores.withColumn("__rs", F.round("score", SCORE_DIGITS))
    w = Window.partitionBy(*q_ids).orderBy(F.col("__rs").desc(), *[F.col(c).asc() for c in tie])
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("__rs")


# ---------------------------------------------------------------------------
# Dense exact inner product (F3): blocks of queries meet blocks of corpus vectors.
# ---------------------------------------------------------------------------
#: Vectors and bytes of a block at most, how many times larger a block of queries is, corpus vectors scored at once.
BLOCK, BLOCK_BYTES, QUERY_TIMES, STRIDE = 4096, 4 << 20, 2, 512


BLOCK_SCHEMA = "block long, dims int, ids binary, body binary"


def vector_rows(df: DataFrame, ident: str, vec: str) -> DataFrame:
    """(id, vec) of the vectors that can be scored: not null, not empty, without null or NaN, with an id."""
    found = df.select(F.col(ident).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    return found.filter(F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)))


def vector_blocks(rows: DataFrame, path: str, times: int = 1) -> DataFrame:
    """(block, dims, ids, body): vectors (id, vec) of one length side by side as binary, written to ``path`` and read back."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        part = TaskContext.get().partitionId()
        waiting, count = {}, 0  # dims -> [ids, vectors, number]

        def emit(dims):
            nonlocal count
            ids, body, _ = waiting.pop(dims)
            count += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + count]), pa.array([dims], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                 pa.array([np.concatenate(body).tobytes()], pa.binary())], ["block", "dims", "ids", "body"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists, ids = batch.column("vec"), batch.column("id").to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            values, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
            for dims in np.unique(sizes).tolist():
                at, most = np.flatnonzero(sizes == dims), times * min(BLOCK, max(1, BLOCK_BYTES // (8 * dims)))
                while at.size:
                    have = waiting.setdefault(dims, [[], [], 0])
                    take, at = at[:most - have[2]], at[most - have[2]:]
                    have[0].append(ids[take])
                    have[1].append(values[(ends[take] - dims)[:, None] + np.arange(dims)])
                    have[2] += take.size
                    if have[2] == most:
                        yield emit(dims)
        for dims in list(waiting):
            yield emit(dims)

    spark = rows.sparkSession
    rows.mapInArrow(run, BLOCK_SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def _best_of_blocks(q, blocks, k: int):
    """(query position, id, score) of all rows of the blocks (ids, vectors) that can be among a query's ``k`` best.

    Kept are the rows that reach the k-th best score less the rounding of
    ``rank_top_k``, and of rows with one score those of the ``k`` smallest ids.
    """
    import numpy as np

    at, ident, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor, slack = np.full(len(q), -np.inf), 10.0 ** -SCORE_DIGITS
    for c_ids, c in blocks:
        for a in range(0, len(c), STRIDE):
            scores = q @ c[a:a + STRIDE].T
            n = scores.shape[1]
            if n > k:
                floor = np.maximum(floor, np.partition(scores, n - k, axis=1)[:, n - k])
            i, j = np.nonzero(scores >= floor[:, None] - slack)
            at, ident, score = np.concatenate([at, i]), np.concatenate([ident, c_ids[a + j]]), np.concatenate([score, scores[i, j]])
            pick = np.lexsort((ident, -score, at))
            at, ident, score = at[pick], ident[pick], score[pick]
            place = np.arange(at.size)
            fresh = np.append(True, (at[1:] != at[:-1]) | (score[1:] != score[:-1]))[:at.size]
            keep = place - np.maximum.accumulate(np.where(fresh, place, 0)) < k
            at, ident, score = at[keep], ident[keep], score[keep]
            last = np.arange(at.size) - np.searchsorted(at, at) == k - 1
            floor[at[last]] = np.maximum(floor[at[last]], score[last])
            keep = score >= floor[at] - slack
            at, ident, score = at[keep], ident[keep], score[keep]
    return at, ident, score


def dense_top_k(spark, queries: DataFrame, corpus: DataFrame, k: int = TOP_K, qid_col: str = "qid",
                q_vec_col: str = "embedding", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """F3 + F5: exact inner-product top-k of every query against every corpus vector.

    Both sides are cut into blocks inside the workers and written.  A block of
    queries makes one cell, or several where there are fewer blocks than tasks;
    the blocks of the corpus are dealt to the cells of their length and stream
    past the queries, so no vector passes through the driver and a worker holds
    one block of queries.  Only a cell's candidates (about ``k`` a query) go
    into the ranking.

    Vectors that are null, empty or hold a null or NaN and rows with a null id
    take no part; vectors of different length never meet.
    """
    held = vector_blocks(vector_rows(corpus, id_col, vec_col), scratch_path(spark, "corpus-blocks"))
    return dense_top_k_of_blocks(vector_rows(queries, qid_col, q_vec_col), held, k, id_col)


def _cells(queries: DataFrame, held: DataFrame) -> DataFrame:
    """Blocks of the queries (id, vec) and the stored corpus blocks dealt to them, sorted by (q_block, cell, side), queries first."""
    spark = queries.sparkSession
    asked = vector_blocks(queries, scratch_path(spark, "query-blocks"), QUERY_TIMES)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = math.ceil(parts / max(1, asked.count()))
    one = asked.select(F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"),
                       F.lit(0).alias("side"), "dims", "ids", "body")
    # the other side of this join is one number a block of queries
    two = held.join(F.broadcast(asked.select(F.col("block").alias("q_block"), "dims")), "dims").select(
        "q_block", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int").alias("cell"), F.lit(1).alias("side"), "dims", "ids", "body")
    return one.unionByName(two).repartition(parts, "q_block", "cell").sortWithinPartitions("q_block", "cell", "side")


def _stream_cells(batches):
    """(query ids, query vectors, iterator of corpus (ids, vectors)) of every cell of a task."""
    import itertools

    import numpy as np

    def blocks():
        for batch in batches:
            for i in range(batch.num_rows):
                ids, body = (batch.column(x)[i].as_buffer() for x in ("ids", "body"))
                yield ((batch.column("q_block")[i].as_py(), batch.column("cell")[i].as_py()), np.frombuffer(ids, np.int64),
                       np.frombuffer(body, np.float64).reshape(-1, batch.column("dims")[i].as_py()))

    for _, cell in itertools.groupby(blocks(), lambda x: x[0]):
        _, q_ids, q = next(cell)
        yield q_ids, q, (x[1:] for x in cell)


def dense_top_k_of_blocks(queries: DataFrame, held: DataFrame, k: int = TOP_K, id_col: str = "vec_id") -> DataFrame:
    """``dense_top_k`` of queries (id, vec) against stored ``vector_blocks``."""
    import pyarrow as pa

    def run(batches):
        for q_ids, q, corpus in _stream_cells(batches):
            at, ident, score = _best_of_blocks(q, corpus, k)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ident), pa.array(score)], ["qid", id_col, "score"])

    found = _cells(queries, held).mapInArrow(run, f"qid long, {id_col} long, score double")
    return rank_top_k(found, ["qid"], [id_col], k)


def dense_score_stats(queries: DataFrame, held: DataFrame) -> DataFrame:
    """(qid, n, best, total) over the scores of every query (id, vec) with all stored vectors of its length."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for q_ids, q, corpus in _stream_cells(batches):
            n, best, total = 0, np.full(len(q), -np.inf), np.zeros(len(q))
            for _, c in corpus:
                for a in range(0, len(c), STRIDE):
                    scores = q @ c[a:a + STRIDE].T
                    n, best, total = n + scores.shape[1], np.maximum(best, scores.max(1)), total + scores.sum(1)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(np.full(len(q), n)), pa.array(best), pa.array(total)],
                                                 ["qid", "n", "best", "total"])

    found = _cells(queries, held).mapInArrow(run, "qid long, n long, best double, total double")
    return found.groupBy("qid").agg(F.sum("n").alias("n"), F.max("best").alias("best"), F.sum("total").alias("total"))
