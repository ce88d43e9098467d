"""Exact Jaccard self-join of word shingle sets, by set relations.

Two documents link when their shingle sets reach a Jaccard similarity of
``num / den``.  The join is exact and never lists the pairs inside a group:

1. Equal sets become one (their number doesn't matter any more).
2. Sets that share a band of minimum hashes are compared with one leader each.
   A verified follower x of leader a knows |x - a|: a highly similar pair.
3. Every set is ordered from its rarest shingle to its most frequent one, and
   its prefix goes into an index (two sets that link share a prefix shingle).
   An index list is cut into blocks by size class, holding one entry a leader
   with the largest remaining length behind the posting.  Lists and blocks
   whose entries all belong to one component are skipped, and so are pairs of
   blocks whose sizes or positions leave too small an overlap.
4. What remains are pairs of leaders.  Parity bitmaps of the sets bound the
   overlap from above: |x & y| <= (|x| + |y| - odd slots of px ^ py) / 2.  Only
   pairs that this bound leaves open are compared element by element, once.  The
   answers of the followers come from it: |x & y| <= |a & b| + |x - a| + |y - b|,
   so most followers need no set at all, and only pairs that may still link are
   compared element by element.

The order of shingles only steers the work; a fixed-size table of frequency
levels, filled from all documents, is enough for it, and the result doesn't
depend on it.

Defined cases: words are runs without ASCII white space, A-Z lower-cased.  A
text with fewer than ``k`` words has its whole word sequence as one shingle; a
null text or one without words has the empty set and links with nothing.  A
null id links with nothing and has a null component.  Rows that repeat an id
are one node.  Extra columns are ignored.  An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import components, cut_batch, map_rows, materialise, may_be_in, member_bits, parts, release, utf8

K, NUM, DEN = 5, 75, 100
BANDS, ROWS = 6, 2
#: Slots of the frequency table; a shingle counts as frequent when a block of texts holds it this often.
LEVEL_SLOTS, LEVEL_LEAST, LEVEL_BLOCK = 1 << 20, 3, 1 << 20
#: Largest parity bitmap in bits; beyond it the bound is looser and the exact comparison decides.
PARITY_MOST = 1 << 17
#: Postings that a task packs at once, those meant for a range of shingles, and those of a packed row at most.
PACK_POSTINGS, RANGE_POSTINGS, ROW_POSTINGS = 1 << 19, 1 << 18, 512
#: Odd constants of the shingle and minimum hashes, drawn once from a seeded generator.
_ODD = np.random.default_rng(20240229).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD[60])
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def word_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, number of words of each text)."""
    joined = np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8)
    blank = _SPACE[joined]
    inside = ~blank
    first = np.flatnonzero(inside & np.append(True, blank[:-1]))
    if not first.size:
        return np.zeros(0, np.uint64), np.zeros(len(bodies), np.int64)
    size = np.flatnonzero(blank & np.append(False, inside[:-1])) - first
    at = np.flatnonzero(inside)
    begins = np.cumsum(size) - size
    place = np.arange(at.size) - np.repeat(begins, size)  # of a byte in its word
    power = np.full(int(size.max()), _ODD[61])
    power[0] = 1
    value = _BYTE[joined[at]] * np.cumprod(power)[place]
    hashes = _mix(np.add.reduceat(value, begins) + size.astype(np.uint64) * _ODD[62])
    ends = np.cumsum([len(b) + 1 for b in bodies])
    return hashes, np.diff(np.searchsorted(first, np.append(0, ends)))


def shingle_sets(bodies: list[bytes], k: int = K) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    flat, sizes = word_hashes([b or b"" for b in bodies])
    n = max(0, flat.size - k + 1)
    every = np.zeros(n, np.uint64)
    for i in range(k):
        every += flat[i:i + n] * _ODD[i]
    every = _mix(every)
    out, at = [], 0
    for size in sizes.tolist():
        if size >= k:
            out.append(np.unique(every[at:at + size - k + 1]))
        elif size:
            out.append(_mix((flat[at:at + size] * _ODD[8:8 + size]).sum(keepdims=True) + np.uint64(size)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def parity_bits(s: np.ndarray) -> bytes:
    """Bitmap of 2 to 4 slots an element (at most PARITY_MOST): whether a slot holds an odd number of them."""
    slots = min(PARITY_MOST, 1 << max(6, s.size.bit_length() + 1))
    counts = np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Odd slots of the symmetric difference, the larger bitmap folded to the smaller one's size."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if a.size != b.size:
        size = min(a.size, b.size)
        a, b = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def need(x: Column, y: Column, num: int, den: int) -> Column:
    """Least overlap of two sets of these sizes that link: overlap * (num + den) >= num * (x + y)."""
    return F.ceil((num * (x + y)) / F.lit(num + den).cast("double") - 1e-9)


def signatures(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(id, n, s1, s2, parity, b0..): set size, 128-bit digest of the set, parity bitmap, bands of minimum hashes."""
    def run(batch: pa.RecordBatch):
        sets = shingle_sets(batch.column("body").to_pylist(), k)
        digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
        low = np.zeros((len(sets), BANDS * ROWS), np.uint64)
        some = np.flatnonzero([s.size > 0 for s in sets])
        if some.size:
            flat, begins = np.concatenate(sets), np.cumsum([0, *(sets[i].size for i in some)])[:-1]
            for j in range(BANDS * ROWS):
                low[some, j] = np.minimum.reduceat(_fold(flat, j), begins)
        bands = _mix((low.reshape(-1, BANDS, ROWS) * _ODD[32:32 + ROWS]).sum(2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([s.size for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
             pa.array([parity_bits(x) for x in sets], pa.binary()), *(pa.array(bands[:, j]) for j in range(BANDS))], ["id", "n", "s1", "s2", "parity", *(f"b{j}" for j in range(BANDS))])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), utf8(F.col(text)).alias("body"))
    return map_rows(rows, run, "id long, n long, s1 long, s2 long, parity binary, " + ", ".join(f"b{j} long" for j in range(BANDS)), "body")


def _fold(s: np.ndarray, j: int) -> np.ndarray:
    x = s * _ODD[16 + j]
    return x ^ (x >> np.uint64(32))


def _levels(rows: DataFrame, only, k: int) -> np.ndarray:
    """Frequency level of every slot: bits of the largest count found among its frequent shingles."""
    def run(batches):
        held, size = [], 0

        def frequent():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LEVEL_LEAST
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["t", "c"])

        for batch in batches:
            bodies = batch.column("body").filter(pa.array(may_be_in(only[1], batch.column("id")))).to_pylist()
            for a in range(0, len(bodies), 256):
                new = shingle_sets(bodies[a:a + 256], k)
                held += new
                size += sum(s.size for s in new)
                if size >= LEVEL_BLOCK:
                    yield frequent()
                    held, size = [], 0
        if held:
            yield frequent()
        release()

    found = (rows.mapInArrow(run, "t long, c long").groupBy("t").agg(F.sum("c").alias("c"))
             .groupBy(F.pmod("t", F.lit(LEVEL_SLOTS)).alias("slot")).agg(F.max("c").alias("c")).toPandas())
    out = np.zeros(LEVEL_SLOTS, np.uint8)
    out[found["slot"].to_numpy(dtype=np.int64)] = np.log2(found["c"].to_numpy(dtype=np.float64)).astype(np.uint8) + 1
    return out


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Numbers as byte planes, which compress well."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes()


def _numbers(x: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1).astype(np.int64)


_POSTING = (("t", "<i8"), ("id", "<i8"), ("n", "<i4"), ("rest", "<i4"))


def _shared_postings(rows: DataFrame, only, levels, k: int, num: int, den: int, total: int) -> DataFrame:
    """(t, id, n, rest): prefix postings of the shingles that the prefixes of two sets share; ``rest`` shingles follow.

    Postings travel once, packed by range of ``t`` and sorted by it.  The task
    of a range holds one posting of every shingle it has met so far, and lets a
    posting go on as soon as its shingle is met again; so a frequent shingle
    takes no more room than a rare one.
    """
    ranges = max(parts(rows.sparkSession), -(-total // RANGE_POSTINGS))

    def pack(batches):
        held, waiting = [[] for _ in _POSTING], 0

        def flush():
            t, *rest = (np.concatenate(x) for x in held)
            for x in held:
                x.clear()
            order = np.argsort(t)
            t, rest = t[order], [x[order] for x in rest]
            to = ((t.astype(np.float64) + 2.0 ** 63) * (ranges / 2.0 ** 64)).astype(np.int64).clip(0, ranges - 1)
            first = np.append(True, to[1:] != to[:-1])
            place = np.arange(to.size) - np.maximum.accumulate(np.where(first, np.arange(to.size), 0))
            edges = np.append(np.flatnonzero(place % ROW_POSTINGS == 0), to.size)
            for a in range(0, edges.size - 1, 1024):
                spans = list(zip(edges[a:a + 1025][:-1].tolist(), edges[a:a + 1025][1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([to[x] for x, _ in spans]), *(pa.array([_planes(v[x:y], kind) for x, y in spans], pa.binary())
                                                           for v, (_, kind) in zip((t, *rest), _POSTING))], ["range", *(c for c, _ in _POSTING)])

        for batch in batches:
            batch = batch.filter(pa.array(may_be_in(only[1], batch.column("id"))))
            for piece in cut_batch(batch, "body", 2 << 20):
                for ident, s in zip(piece.column("id").to_pylist(), shingle_sets(piece.column("body").to_pylist(), k)):
                    if not s.size:
                        continue
                    length = s.size - -(-num * s.size // den) + 1
                    level = levels.value[s.view(np.int64) % LEVEL_SLOTS].astype(np.uint64)
                    order = np.argsort(level << np.uint64(57) | s >> np.uint64(7), kind="stable")[:length]
                    new = s[order].view(np.int64), np.full(length, ident), np.full(length, s.size), s.size - 1 - np.arange(length)
                    for to, x in zip(held, new):
                        to.append(x)
                    waiting += length
                    if waiting >= PACK_POSTINGS:
                        yield from flush()
                        waiting = 0
        if waiting:
            yield from flush()
        release()

    def shared(batches):
        known = [np.zeros(0, np.int64) for _ in _POSTING]  # one posting of each shingle met
        met = np.zeros(0, bool)  # whether it has gone on

        def meet(new):
            nonlocal known, met
            every = [np.concatenate(x) for x in zip(known, new)]  # known ones come first
            order = np.argsort(every[0], kind="stable")
            every = [x[order] for x in every]
            gone = np.concatenate([met, np.zeros(new[0].size, bool)])[order]
            first = np.append(True, every[0][1:] != every[0][:-1])
            group = np.cumsum(first) - 1
            heads = np.flatnonzero(first)
            many = np.diff(np.append(heads, first.size)) > 1
            out = many[group] & ~gone
            known, met = [x[heads] for x in every], gone[heads] | many
            return pa.RecordBatch.from_arrays([pa.array(x[out]) for x in every], [c for c, _ in _POSTING])

        waiting, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c, _ in _POSTING)):
                waiting.append([_numbers(x, kind) for x, (_, kind) in zip(row, _POSTING)])
                size += waiting[-1][0].size
                if size >= RANGE_POSTINGS:
                    yield meet([np.concatenate(x) for x in zip(*waiting)])
                    waiting, size = [], 0
        if waiting:
            yield meet([np.concatenate(x) for x in zip(*waiting)])
        release()

    packed = rows.mapInArrow(pack, "range long, t binary, id binary, n binary, rest binary").repartition(ranges, "range")
    return packed.mapInArrow(shared, "t long, id long, n long, rest long")


def _open(pairs: DataFrame, signed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y, floor) whose overlap may let them link, or may reach ``floor`` where that isn't null."""
    def run(batches):
        for batch in batches:
            px, py = (batch.column(c).to_pylist() for c in ("px", "py"))
            total = (batch.column("nx").to_numpy() + batch.column("ny").to_numpy()).astype(np.int64)
            most = (total - np.fromiter(map(differing, px, py), np.int64, len(px))) // 2
            floor = batch.column("floor").fill_null(1 << 62).to_numpy(zero_copy_only=False)
            yield batch.select(["x", "y", "floor"]).filter(pa.array((most * (num + den) >= num * total) | (most >= floor)))

    of = lambda c: signed.select(F.col("id").alias(c), F.col("n").alias("n" + c), F.col("parity").alias("p" + c))
    return (pairs.select("x", "y", F.col("floor").cast("bigint").alias("floor")).join(of("x"), "x").join(of("y"), "y")
            .mapInArrow(run, "x long, y long, floor long"))


def _overlaps(pairs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Add the overlap ``o`` and the sizes ``nx``, ``ny`` to pairs (x, y)."""
    spark = pairs.sparkSession
    pairs = materialise(pairs.select("x", "y").distinct(), "jaccard-pairs")
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y"))

    def run(batch: pa.RecordBatch):
        sets = [s.view(np.int64) for s in shingle_sets(batch.column("body").to_pylist(), k)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    wanted = spark.sparkContext.broadcast(member_bits(ids, "id"))
    if wanted.value is None:  # too many for a filter
        rows = rows.join(ids.distinct(), "id", "left_semi")
    sets = materialise(map_rows(rows, run, "id long, s array<long>", "body", only=("id", wanted)), "jaccard-sets")
    return (pairs.join(sets.select(F.col("id").alias("x"), F.col("s").alias("sx")), "x")
            .join(sets.select(F.col("id").alias("y"), F.col("s").alias("sy")), "y")
            .select("x", "y", F.size(F.array_intersect("sx", "sy")).cast("bigint").alias("o"),
                    F.size("sx").cast("bigint").alias("nx"), F.size("sy").cast("bigint").alias("ny")))


def links(rows: DataFrame, reps: DataFrame, signed: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """Edges (a, b) among distinct sets; their components are those of all links.

    ``rows``: (id, body) of all texts; ``reps``: (id, n, b0..) of one text a distinct set;
    ``signed``: (id, n, parity) of all texts.
    """
    spark = rows.sparkSession
    only = ("id", spark.sparkContext.broadcast(member_bits(reps, "id")))
    if only[1].value is None:  # too many for a filter
        rows = rows.join(reps.select("id"), "id", "left_semi")
    linked = F.col("o") >= need(F.col("nx"), F.col("ny"), num, den)

    # relations: each set with the leader it shares most bands with
    bands = reps.select("id", F.explode(F.array(*(f"b{j}" for j in range(BANDS)))).alias("band"))
    leaders = materialise(bands.groupBy("band").agg(F.min("id").alias("lead"), F.count("*").alias("c")).filter("c > 1")
                          .select("band", "lead"), "jaccard-leaders")
    star = (bands.join(leaders, "band").filter("lead <> id").groupBy("id", "lead").agg(F.count("*").alias("c"))
            .groupBy("id").agg(F.max_by("lead", F.struct(F.col("c"), -F.col("lead"))).alias("lead")))
    star = star.select(F.col("id").alias("x"), F.col("lead").alias("y"), F.lit(None).alias("floor"))
    found = materialise(_overlaps(_open(star, signed, num, den), rows, k)
                        .filter(linked).select("x", "y", (F.col("nx") - F.col("o")).alias("off")), "jaccard-stars")
    near = components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    # (id, comp, lead, off): follower's leader and |x - a|
    related = materialise(reps.select("id").join(near.withColumnRenamed("node", "id"), "id", "left")
                          .join(found.select(F.col("x").alias("id"), F.col("y").alias("lead"), "off"), "id", "left")
                          .select("id", F.coalesce("component", "id").alias("comp"), F.coalesce("lead", "id").alias("lead"),
                                  F.coalesce("off", F.lit(0)).alias("off")), "jaccard-related")

    # index: postings of the shingles that two prefixes share
    levels = spark.sparkContext.broadcast(_levels(rows, only, k))
    total = reps.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    listed = materialise(_shared_postings(rows, only, levels, k, num, den, total).join(related, "id"), "jaccard-index")
    mixed = materialise(listed.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                        .filter("lo < hi").select("t"), "jaccard-mixed")
    step = math.log(den / num)
    entries = materialise(listed.join(mixed, "t", "left_semi")
                          .withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / step).cast("int")), "jaccard-entries")

    # blocks against blocks: components differ, sizes and positions allow the overlap
    blocks = materialise(entries.groupBy("t", "cls", "lead", "comp").agg(
        F.max("rest").alias("rest"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("off").alias("off"),
        F.max((F.col("id") != F.col("lead")).cast("int")).alias("many")), "jaccard-blocks")
    side = lambda df, p: df.select("t", *(F.col(c).alias(p + c) for c in df.columns if c != "t"))
    touch = (side(blocks, "x_").join(side(blocks, "y_"), "t")
           .filter((F.col("x_lead") < F.col("y_lead")) & (F.col("x_comp") != F.col("y_comp"))
                   & (F.abs(F.col("x_cls") - F.col("y_cls")) <= 1)
                   & (den * F.col("x_hi") >= num * F.col("y_lo")) & (den * F.col("y_hi") >= num * F.col("x_lo"))
                   & (1 + F.least("x_rest", "y_rest") >= need(F.col("x_lo"), F.col("y_lo"), num, den))))
    touch = materialise(touch.select("t", "x_cls", "y_cls", "x_lead", "y_lead", (F.col("x_lo") + F.col("y_lo")).alias("least"),
                                     (F.col("x_off") + F.col("y_off")).alias("off"),
                                     (F.col("x_many") + F.col("y_many")).alias("many")), "jaccard-touch")
    met = (touch.groupBy("x_lead", "y_lead").agg(F.min("least").alias("least"), F.max("off").alias("off"), F.max("many").alias("many")))
    met = materialise(met.select(F.col("x_lead").alias("x"), F.col("y_lead").alias("y"), "least", "off", "many"), "jaccard-met")
    likely = _open(met.withColumn("floor", F.when(F.col("many") > 0, need(F.col("least"), F.lit(0), num, den) - F.col("off"))),
                   signed, num, den)
    over = materialise(_overlaps(likely, rows, k).join(met, ["x", "y"]), "jaccard-over")
    direct = over.filter(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))

    # followers derive their answers from their leaders' overlap
    open_pairs = materialise(over.filter((F.col("many") > 0) & ~linked
                                         & (F.col("o") + F.col("off") >= need(F.col("least"), F.lit(0), num, den)))
                             .select(F.col("x").alias("x_lead"), F.col("y").alias("y_lead"), "o"), "jaccard-open")
    where = materialise(touch.select("t", "x_cls", "y_cls", "x_lead", "y_lead").join(open_pairs, ["x_lead", "y_lead"]),
                        "jaccard-where")
    one = entries.select("t", *(F.col(c).alias("x_" + c) for c in ("cls", "id", "n", "rest", "lead", "off")))
    two = entries.select("t", *(F.col(c).alias("y_" + c) for c in ("cls", "id", "n", "rest", "lead", "off")))
    least = need(F.col("x_n"), F.col("y_n"), num, den)
    # a follower meets the block of the other side first: most can't reach its least need even with its largest offset
    facing = blocks.select("t", F.col("cls").alias("y_cls"), F.col("lead").alias("y_lead"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"),
                           F.col("off").alias("b_off"), F.col("rest").alias("b_rest"))
    floor = need(F.col("x_n"), F.col("b_lo"), num, den)
    alive = (where.join(facing, ["t", "y_cls", "y_lead"]).join(one, ["t", "x_cls", "x_lead"])
             .filter((F.col("o") + F.col("x_off") + F.col("b_off") >= floor) & (1 + F.least("x_rest", "b_rest") >= floor)
                     & (den * F.col("x_n") >= num * F.col("b_lo")) & (den * F.col("b_hi") >= num * F.col("x_n"))).drop("b_lo", "b_hi", "b_off", "b_rest"))
    members = (alive.join(two, ["t", "y_cls", "y_lead"])
               .filter((1 + F.least("x_rest", "y_rest") >= least) & (F.col("o") + F.col("x_off") + F.col("y_off") >= least)
                       & (F.lit(den) * F.least("x_n", "y_n") >= F.lit(num) * F.greatest("x_n", "y_n")))
               .select(F.col("x_id").alias("x"), F.col("y_id").alias("y"), F.lit(None).alias("floor")).distinct())
    derived = _overlaps(_open(members, signed, num, den), rows, k).filter(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return materialise(found.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(direct)
                       .unionByName(derived), "jaccard-links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, num: int = NUM,
                    den: int = DEN) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    signed = materialise(signatures(docs, doc_id, text, k), "jaccard-signs")
    live = signed.filter("n > 0 AND id IS NOT NULL")
    sets = materialise(live.groupBy("s1", "s2", "n").agg(
        F.min("id").alias("id"), *(F.min(f"b{j}").alias(f"b{j}") for j in range(BANDS))), "jaccard-reps")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), utf8(F.col(text)).alias("body"))
    edges = links(rows, sets, live.select("id", "n", "parity"), k, num, den)
    # a repeated id may stand for several sets, and each of them joins the id's node
    held = live.groupBy("id").agg(F.count_distinct("s1", "s2", "n").alias("c")).filter("c > 1").select("id")
    ties = (live.join(held, "id", "left_semi").join(sets.select("s1", "s2", "n", F.col("id").alias("rep")), ["s1", "s2", "n"])
            .select(F.col("id").alias("a"), F.col("rep").alias("b")))
    comp = components(edges.unionByName(ties))
    by_set = materialise(sets.select("s1", "s2", "n", "id").join(comp.withColumnRenamed("node", "id"), "id", "left")
                         .select("s1", "s2", "n", F.coalesce("component", "id").alias("component")), "jaccard-sets")
    return (signed.select("id", "n", "s1", "s2").join(by_set, ["s1", "s2", "n"], "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")))
