"""The trie of conversation prefixes, as balanced parentheses in shards.

Every conversation is first rebuilt on a shared opening (``rebuild``); any table
of (conv_id, d, t1, t2, n_bytes, ends) can be indexed.

1. A turn is two 64-bit hashes of (role, text); texts are not shuffled.  A
   prefix is the xor of the hashes of its (depth, turn), a running total, so one
   long conversation is spread over many tasks (``operators.running``).
2. Prefixes with equal hash and depth are one node: a grouped aggregate with
   partial sums gives members, smallest member and bytes.
3. Nodes below each other with the same members form a run, known by (smallest
   member, members).  A conversation's path is its runs; one path is kept for
   each distinct conversation.  A path of k runs needs k conversations that
   leave it at k depths, so N turns allow paths of at most about sqrt(2 N) runs.
4. Paths are range sorted, which is the trie's depth-first order, and cut into
   shards of bounded size.  A shard writes its trie as balanced parentheses with
   a tree of block minima over the excess; findclose delimits every subtree,
   the rank of leaf pairs "()" inside counts its leaves, and cumulative sums over
   preorder give its savings.  A shard's first and last path may go on in its
   neighbours: these spines are merged by adding what each shard counted.  A
   run's own savings and its place as a child count only in the shard that holds
   the path of its smallest member.
5. Nodes take their run's figures, less what the run saves above them.

``ends_sha256`` hashes ids in numeric order.  A group that lies in several
partitions of the sorted ids, or holds more than ``BLOB_BYTES`` of them, is
joined from blobs, so that no task holds a whole group.

Nulls: a null role or text is empty, a null turn comes first, rows with a null
conv_id take no part.  Turns with the same number are ordered by their hash.  An
empty table gives an empty result.  Other columns are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise, parts
from lectern.operators.running import running_totals

#: Conversations that share an opening, and the modulus of its length.
FAMILY, OPENINGS = 5, 9
#: Path entries of a shard, parentheses of a block, bytes of an unfinished list of ids.
SHARD, BLOCK, BLOB_BYTES = 1 << 18, 64, 1 << 20
NO_END = hashlib.sha256(b"").hexdigest()


# --- balanced parentheses ----------------------------------------------------

class Parens:
    """A sequence of parentheses with a range min-max tree over its excess."""

    def __init__(self, is_open: np.ndarray):
        n = is_open.size
        self.is_open = is_open
        self.excess = np.cumsum(np.where(is_open, 1, -1))
        rows = -(-n // BLOCK)
        self.blocks = np.full((rows, BLOCK), np.iinfo(np.int64).max)
        self.blocks.reshape(-1)[:n] = self.excess
        self.levels = [self.blocks.min(1)]  # block minima, then minima of pairs
        while self.levels[-1].size > 1:
            low = self.levels[-1]
            if low.size % 2:
                low = np.append(low, np.iinfo(np.int64).max)
            self.levels.append(np.minimum(low[::2], low[1::2]))
        leaf = np.append(is_open[:-1] & ~is_open[1:], False) if n else is_open
        self.leaf_rank = np.append(0, np.cumsum(leaf))  # "()" that start before a position

    def leaves(self, opened: np.ndarray, closed: np.ndarray) -> np.ndarray:
        return self.leaf_rank[closed] - self.leaf_rank[opened]

    def findclose(self, opened: np.ndarray) -> np.ndarray:
        """Position of the parenthesis that closes each opened one."""
        want = self.excess[opened] - 1
        found = np.full(opened.size, -1)
        for a in range(0, opened.size, 1 << 14):
            found[a:a + (1 << 14)] = self._inside(opened[a:a + (1 << 14)] // BLOCK, want[a:a + (1 << 14)], opened[a:a + (1 << 14)] % BLOCK)
        at = np.flatnonzero(found < 0)
        node, level, target = opened[at] // BLOCK, np.full(at.size, -1), want[at]
        for k, low in enumerate(self.levels):  # up to the first block to the right that goes low enough
            right = np.minimum(node + 1, low.size - 1)
            hit = (level < 0) & (node % 2 == 0) & (node + 1 < low.size) & (low[right] <= target)
            node, level = np.where(hit, node + 1, np.where(level < 0, node // 2, node)), np.where(hit, k, level)
        for k in range(len(self.levels) - 1, 0, -1):  # and down to it
            down = level >= k
            left = np.minimum(2 * node, self.levels[k - 1].size - 1)
            node = np.where(down, np.where(self.levels[k - 1][left] <= target, 2 * node, 2 * node + 1), node)
        for a in range(0, at.size, 1 << 14):
            some = slice(a, a + (1 << 14))
            found[at[some]] = self._inside(node[some], target[some], np.full(node[some].size, -1))
        return found

    def _inside(self, block: np.ndarray, want: np.ndarray, after: np.ndarray) -> np.ndarray:
        hit = (self.blocks[block] <= want[:, None]) & (np.arange(BLOCK) > after[:, None])
        first = hit.argmax(1)
        return np.where(hit[np.arange(block.size), first], block * BLOCK + first, -1)


def shard_runs(reps: np.ndarray, sizes: np.ndarray, flat: dict[str, np.ndarray], last_is_leaf: bool) -> dict[str, np.ndarray]:
    """Figures of the runs of one shard.

    ``reps``: conversation of each path, in depth-first order; ``sizes``: runs of
    each path; ``flat``: m, n, before, after (and more) of all runs, path by path.
    """
    m, n = flat["m"].tolist(), flat["n"].tolist()
    stack: list[int] = []  # preorder numbers of the open runs
    kept: list[int] = []  # entry that opens each run
    parent: list[int] = []
    turns: list[int] = []  # opened and closed in turn
    a, before = 0, (0, 0)
    for size in sizes.tolist():
        shared, upto = 0, min(size, len(stack))
        b = before[0]
        while shared < upto and m[a + shared] == m[b + shared] and n[a + shared] == n[b + shared]:
            shared += 1
        if turns:
            turns.append(len(stack) - shared)
        del stack[shared:]
        turns.append(size - shared)
        for i in range(a + shared, a + size):
            parent.append(stack[-1] if stack else -1)
            stack.append(len(kept))
            kept.append(i)
        before, a = (a, size), a + size
    turns.append(len(stack))
    entry, up = np.array(kept), np.array(parent)
    tree = Parens(np.repeat(np.arange(len(turns)) % 2 == 0, turns))
    opened = np.flatnonzero(tree.is_open)
    closed = tree.findclose(opened)
    below = (closed - opened + 1) // 2  # nodes of the subtree, its top included
    got = {k: v[entry] for k, v in flat.items()}
    here = np.isin(got["m"], reps)
    saves = np.append(0, np.cumsum(np.where(here, (got["n"] - 1) * (got["after"] - got["before"]), 0)))
    place = np.arange(entry.size)
    leaves = tree.leaves(opened, closed)
    spine = np.zeros(entry.size, bool)
    spine[:sizes[0]] = True
    spine[stack] = True
    if not last_is_leaf:  # its last run goes on in the next shard
        leaves[stack] -= 1
    return got | {"up": np.where(up < 0, got["m"], got["m"][up]), "top": up < 0, "leaves": leaves, "saved": saves[place + below] - saves[place],
                  "children": np.bincount(up[(up >= 0) & here], minlength=entry.size), "spine": spine}


# --- conversations -----------------------------------------------------------

def rebuild(conv: DataFrame) -> DataFrame:
    """(conv_id, d, t1, t2, n_bytes, ends): the rebuilt turns, and one row of depth 0 for every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conv.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), role, text).alias("t2"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.lit(1).cast("bigint").alias("one"))
    own = running_totals(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")], {"pos": ("sum", "one")}, "turns")
    own = own.select("conv_id", "pos", "t1", "t2", "n_bytes")
    sizes = materialise(own.groupBy("conv_id").agg(F.max("pos").alias("n")), "turn-counts")
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    opening = F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS
    joined = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", opening).join(bases, "base", "left")
    joined = joined.withColumn("lead", F.least("h", F.coalesce("n_base", F.lit(0).cast("bigint"))))
    joined = materialise(joined.withColumn("length", F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("bigint"))), "openings")
    after = own.join(joined.select("conv_id", "h", "lead", "length"), "conv_id").filter("pos > h").withColumn("d", F.expr("pos - h + lead"))
    lent = (own.filter(F.col("pos") < OPENINGS).withColumnRenamed("conv_id", "base")
            .join(joined.select("conv_id", "base", "h", "length"), "base").filter("pos <= h").withColumn("d", F.col("pos")))
    zero = F.lit(0).cast("bigint")
    tops = joined.select("conv_id", "length", zero.alias("d"), zero.alias("t1"), zero.alias("t2"), zero.alias("n_bytes"))
    every = None
    for x in (tops, after, lent):
        x = x.select("conv_id", "d", "t1", "t2", "n_bytes", (F.col("d") == F.col("length")).cast("bigint").alias("ends"))
        every = x if every is None else every.unionByName(x)
    return every


def _paths(chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, path): the runs of every conversation from the root down."""
    met = chains.join(nodes.select("d", "h1", "h2", "m", "n"), ["d", "h1", "h2"])
    runs = met.groupBy("conv_id", "m", "n").agg(F.min("d").alias("d0"), F.max("d").alias("d1"),
                                                F.min(F.col("cum") - F.col("n_bytes")).alias("before"), F.max("cum").alias("after"))
    path = F.array_sort(F.collect_list(F.struct("d0", "m", "n", "d1", "before", "after")))
    return runs.groupBy("conv_id").agg(path.alias("path"))


def _runs(paths: DataFrame) -> DataFrame:
    """(m, n, up, top, d0, d1, before, leaves, saved, children) of every run; ``paths``: (rep, path, leaf)."""
    spark = paths.sparkSession
    key = F.transform("path", lambda x: x["m"])
    rows = paths.withColumn("key", key).repartitionByRange(parts(spark), "key").sortWithinPartitions("key").drop("key")
    numbers = ("m", "n", "d0", "d1", "before", "after")
    out = (("m", "long"), ("n", "long"), ("up", "long"), ("top", "boolean"), ("d0", "long"), ("d1", "long"), ("before", "long"),
           ("leaves", "long"), ("saved", "long"), ("children", "long"), ("spine", "boolean"))

    def shard(waiting):
        reps = np.concatenate([b.column("rep").to_numpy() for b in waiting])
        lists = [b.column("path") for b in waiting]
        sizes = np.concatenate([x.value_lengths().to_numpy() for x in lists])
        flat = {k: np.concatenate([pa.compute.struct_field(x.flatten(), k).to_numpy() for x in lists]) for k in numbers}
        got = shard_runs(reps, sizes, flat, waiting[-1].column("leaf")[-1].as_py())
        return pa.RecordBatch.from_arrays([pa.array(got[k]) for k, _ in out], [k for k, _ in out])

    def run(batches):
        waiting, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            held += len(batch.column("path").flatten())
            if held >= SHARD:
                yield shard(waiting)
                waiting, held = [], 0
        if waiting:
            yield shard(waiting)

    found = materialise(rows.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in out)), "trie-shards")
    whole = [k for k, _ in out if k != "spine"]
    merged = found.filter("spine").groupBy("m", "n").agg(
        *(F.max(k).alias(k) for k in ("up", "top", "d0", "d1", "before")), *(F.sum(k).alias(k) for k in ("leaves", "saved", "children")))
    return found.filter("not spine").select(*whole).unionByName(merged.select(*whole))


def _ends(ends: DataFrame) -> DataFrame:
    """(m, n, ends_sha256) of (m, n, conv_id): ids in numeric order, joined by commas."""
    spark = ends.sparkSession
    rows = ends.repartitionByRange(parts(spark), "m", "n", "conv_id").sortWithinPartitions("m", "n", "conv_id")
    names = ["m", "n", "part", "seq", "digest", "ids"]

    def run(batches):
        part = TaskContext.get().partitionId()
        group, ids, held, seq, broken = None, [], 0, 0, True  # a partition's first group may have begun before
        made: list[tuple] = []

        def put(last: bool):
            nonlocal ids, held, seq
            if last and not broken:
                made.append((*group, part, 0, hashlib.sha256(",".join(ids).encode()).hexdigest(), None))
            elif ids:
                made.append((*group, part, seq, None, ",".join(ids).encode()))
            seq, ids, held = seq + 1, [], 0

        def flush():
            cols, out = list(zip(*made)) if made else [[]] * 6, pa.schema(
                [("m", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("digest", pa.string()), ("ids", pa.binary())])
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], names)

        for batch in batches:
            for m, n, c in zip(*(batch.column(k).to_pylist() for k in ("m", "n", "conv_id"))):
                if (m, n) != group:
                    if group is not None:
                        put(True)
                        broken, seq = False, 0
                    group = (m, n)
                ids.append(str(c))
                held += len(ids[-1]) + 1
                if held > BLOB_BYTES:
                    broken = True
                    put(False)
            if made:
                yield flush()
        if group is not None:
            broken = True  # the last group may go on
            put(True)
            yield flush()

    found = materialise(rows.mapInArrow(run, "m long, n long, part int, seq int, digest string, ids binary"), "ends")
    blobs = (found.filter("ids is not null").select("m", "n", "part", "seq", "ids").repartition("m", "n")
             .sortWithinPartitions("m", "n", "part", "seq"))

    def join(batches):
        group, sha = None, None
        for batch in batches:
            done = []
            for m, n, ids in zip(*(batch.column(k).to_pylist() for k in ("m", "n", "ids"))):
                if (m, n) != group:
                    if group is not None:
                        done.append((*group, sha.hexdigest()))
                    group, sha = (m, n), hashlib.sha256(ids)
                else:
                    sha.update(b"," + ids)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["m", "n", "digest"])
        if group is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*group, sha.hexdigest())], ["m", "n", "digest"])

    joined = blobs.mapInArrow(join, "m long, n long, digest string")
    return found.filter("digest is not null").select("m", "n", "digest").unionByName(joined).withColumnRenamed("digest", "ends_sha256")


def trie(rows: DataFrame) -> DataFrame:
    """One row a node of the trie of (conv_id, d, t1, t2, n_bytes, ends); depth 0 is a row without turn for each conversation."""
    top = F.col("d") == 0
    hashed = rows.select("conv_id", "d", "n_bytes", "ends", *(
        F.when(top, F.lit(0)).otherwise(F.xxhash64(F.lit(k), "d", "t1", "t2")).alias(f"e{k}") for k in (1, 2)))
    chains = running_totals(hashed, ["conv_id"], [F.col("d")], {"h1": ("xor", "e1"), "h2": ("xor", "e2"), "cum": ("sum", "n_bytes")}, "chains")
    chains = chains.select("conv_id", "d", "h1", "h2", "cum", "n_bytes")
    nodes = materialise(chains.groupBy("d", "h1", "h2").agg(F.min("conv_id").alias("m"), F.count(F.lit(1)).alias("n"), F.max("cum").alias("cum"),
                                                            F.max("n_bytes").alias("n_bytes")), "nodes")
    paths = materialise(_paths(chains, nodes), "paths")
    last = F.element_at("path", -1)
    ends = paths.select(last["m"].alias("m"), last["n"].alias("n"), "conv_id")
    reps = ends.groupBy("m", "n").agg(F.min("conv_id").alias("conv_id"), (F.count(F.lit(1)) == F.col("n")).alias("leaf"))
    kept = paths.join(reps.select("conv_id", "leaf"), "conv_id").select(F.col("conv_id").alias("rep"), "path", "leaf")
    runs = materialise(_runs(kept).join(_ends(ends), ["m", "n"], "left"), "runs")
    above = (F.col("cum") - F.col("n_bytes") - F.col("before")) * (F.col("n") - 1)
    at_end = F.col("d") == F.col("d1")
    return nodes.drop("h1", "h2").join(runs, ["m", "n"]).select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") > F.col("d0"), F.col("m")).when(~F.col("top"), F.col("up")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(at_end, F.col("children")).otherwise(F.lit(1).cast("bigint")).alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") - above).alias("saved_tokens"),
        F.when(at_end, F.coalesce("ends_sha256", F.lit(NO_END))).otherwise(F.lit(NO_END)).alias("ends_sha256"))


def conversation_trie(conv: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of the rebuilt conversations."""
    return trie(rebuild(conv))
