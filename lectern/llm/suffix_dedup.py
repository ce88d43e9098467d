"""Removal of long repeated byte strings with run-length compressed indexes.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else is removed.  A window of that length can only repeat where its anchor (the
k-gram of least hash inside it, leftmost among equals) repeats, so windows are
grouped by anchor: consecutive windows of one anchor form a span, equal spans
become one row with a count, and spans whose anchor occurs once are done.

Spans that occur twice or more are marked at once.  The other spans of an
anchor meet the distinct spans of that anchor in a run-length index: a shard
of anchors builds the Burrows-Wheeler transform of its distinct spans, keeps
its runs, and samples the text position and the length of the common prefix at
both ends of every run.  Inside a run that length falls by one from one text
position to the next, so streaming the text past the samples gives the matching
statistics of every position against all others, and positions that reach
``length`` begin a repeated window.

An anchor with more than ``most`` distinct spans would make a hot group.  Its
spans are cut into classes of windows by their place around the anchor, and the
bytes that all windows of a class share join the group's key; after classes of
1/8, 1/56 and single windows every group is small or a plain count.  No window
is in two spans, so nothing matches itself.

``repeated_passages`` finds the runs of ``WORDS`` words that also start
elsewhere, however few bytes they take, and removes nothing.  Its windows are
words (hashed), its anchors 18 of them; equal spans are counted by a hash, the
windows of the others by theirs.

Defined cases: texts are their UTF-8 bytes, a null text is empty.  Texts under
``length`` bytes lose nothing.  Rows that repeat (same id and text) are
documents of their own: their windows repeat.  Null ids are kept.  Extra
columns are ignored.  An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import in_bits, map_rows, materialise, member_bits, parts, release, utf8

LENGTH = 400
#: Bytes of an anchor: a window then holds ``LENGTH - 65 + 1`` = 336 = 8 * 7 * 6 of them.
GRAM = 65
CLASSES = (336, 42, 6, 1)
#: A passage of this many words is one even under ``LENGTH`` bytes; the bytes that such a passage has at least
#: (words of three letters and a space), and the classes of its windows.
WORDS, PASSAGE, PASSAGE_CLASSES = 50, 200, (168, 42, 6, 1)
#: Words of an anchor, where windows are words.
WORD_GRAM = 18
#: Distinct spans that one index group may hold, and bytes meant for a shard.
MOST, SHARD_BYTES = 256, 1 << 19
#: Positions hashed at once in a long text (the anchor's place takes 24 bits of its sort key).
STRETCH = 1 << 22

_BYTE = np.random.default_rng(417).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFF)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _gram_hashes(body: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes (or word hashes) from every position: hashes of 1, 2, 4, ... are joined, then those of k's bits."""
    parts_, width, power = _BYTE[body] if body.dtype == np.uint8 else body, 1, _STEP
    out, have = None, 0
    while True:
        if k & width:
            n = body.size - have - width + 1
            out = parts_ if out is None else out[:n] * power + parts_[have:have + n]
            have += width
        if width * 2 > k:
            break
        n = body.size - 2 * width + 1
        parts_ = parts_[:n] * power + parts_[width:width + n]
        power, width = np.uint64((int(power) ** 2 + 2) & 0xFFFFFFFFFFFFFFFF), width * 2
    x = out[:body.size - k + 1]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def anchors(body: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of a text (bytes, or word hashes): (first window, windows, anchor position, anchor hash)."""
    found = []
    reach = length - k + 1
    for a in range(0, body.size - length + 1, STRETCH):
        windows = min(STRETCH, body.size - length + 1 - a)
        h = _gram_hashes(body[a:a + windows + length - 1], k)
        key = (h & ~_LOW) | np.arange(h.size, dtype=np.uint64)
        low, width = key, 1
        while width * 2 <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:windows], low[reach - width:reach - width + windows])
        at = (low & _LOW).astype(np.int64)
        first = np.append(0, np.flatnonzero(np.diff(at)) + 1)
        count = np.diff(np.append(first, windows))
        found.append((first + a, count, at[first] + a, h[at[first]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


OCC = "doc_id long, th long, start long, n long, at long, key long, s1 long, s2 long, weight long"
_OCC_NAMES = [x.split()[0] for x in OCC.split(", ")]


def _occurrence(body: bytes, start: int, n: int, length: int) -> tuple[int, int]:
    d = hashlib.blake2b(memoryview(body)[start:start + n - 1 + length], digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _occ_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], _OCC_NAMES)


def _first_spans(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Every span of every text; ``n`` windows from ``start``, the anchor ``at`` bytes later."""
    def run(batch: pa.RecordBatch):
        found, row, digests = [], [], []
        for i, body in enumerate(batch.column("body").to_pylist()):
            first, count, place, key = anchors(np.frombuffer(body, np.uint8), length, k)
            found.append((first, count, place - first, key.view(np.int64)))
            row.append(np.full(first.size, i))
            view = memoryview(body)
            digests += [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (first + count - 1 + length).tolist())]
        row = pa.array(np.concatenate(row))
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)  # as of _occurrence
        cols = (*(np.concatenate(x) for x in zip(*found)), np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]),
                np.ones(len(digests), np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("th").take(row), *map(pa.array, cols)], _OCC_NAMES)

    return map_rows(docs.filter(F.octet_length("body") >= length), run, OCC, "body")


def _split(listed: DataFrame, length: int, width: int) -> DataFrame:
    """Spans of (doc_id, th, body, spans) cut into classes of ``width`` windows around their anchor."""
    def run(batch: pa.RecordBatch):
        rows = []
        for ident, th, body, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "body", "spans"))):
            for s in spans:
                place = s["start"] + s["at"]  # of the anchor
                stop, a = s["start"] + s["n"], s["start"]
                while a < stop:
                    cls = (place - a) // width
                    b = min(stop, place - cls * width + 1)
                    core = body[place - cls * width:place - (cls + 1) * width + 1 + length]  # in every window of the class
                    key = xxhash.xxh64_intdigest(core, (s["key"] + cls * 0x9E3779B9) & 0xFFFFFFFFFFFFFFFF)
                    key = key - (1 << 64) if key >> 63 else key
                    rows.append((ident, th, a, b - a, place - a, key, *_occurrence(body, a, b - a, length), s["weight"]))
                    a = b
            if len(rows) > 50_000:
                yield _occ_batch(rows)
                rows = []
        if rows:
            yield _occ_batch(rows)

    return map_rows(listed, run, OCC, "body")


def _with_bodies(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, th, body, spans): texts with their listed spans; other texts are not moved."""
    spark = docs.sparkSession
    listed = materialise(spans.groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("start", "n", "at", "key", "weight")).alias("spans")), "suffix-lists")
    hit = docs.filter(in_bits(spark, F.col("th"), member_bits(listed, "th"))).dropDuplicates(["doc_id", "th"])
    # one plan at every size: the listed texts meet their spans in a sorted merge
    right = listed.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "spans").hint("merge")
    return hit.join(right, hit.doc_id.eqNullSafe(F.col("_d")) & (hit.th == F.col("_t"))).select("doc_id", "th", "body", "spans")


# --- run-length index of one shard -------------------------------------------

class RunIndex:
    """Run-length Burrows-Wheeler transform of distinct texts, sampled at run ends.

    ``head_at``/``tail_at``: text positions of the suffixes at the ends of the
    runs; ``prefix``: common prefix of each run's first suffix and the suffix
    before it, which is the last one of the run before.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.text = np.frombuffer(b"".join(t + b"\0" for t in texts) + b"\0" * 8, np.uint8)
        n = int(sizes.sum() + sizes.size)
        self.ends = np.cumsum(sizes + 1) - 1
        self.firsts = self.ends - sizes
        owner = np.repeat(np.arange(sizes.size), sizes + 1)
        self.stop = self.ends[owner]  # end of the text that holds a position
        order = self._order(n, owner)
        before = np.empty(n, np.int64)  # symbol before each suffix; text ends all differ
        symbol = self.text[:n].astype(np.int64)
        symbol[self.ends] = 256 + np.arange(sizes.size)
        before[1:], before[0] = symbol[:-1], symbol[-1]
        bwt = before[order]
        heads = np.append(0, np.flatnonzero(bwt[1:] != bwt[:-1]) + 1)
        self.runs = bwt[heads]
        self.head_at = order[heads]
        self.tail_at = order[np.append(heads[1:], n) - 1]
        self.prefix = np.append(0, self._common(self.tail_at[:-1], self.head_at[1:]))

    def _order(self, n: int, owner: np.ndarray) -> np.ndarray:
        """Suffixes in order, text ends below all bytes and among themselves by text."""
        left = self.stop - np.arange(n)  # bytes before the text ends
        value = np.append(self.text[:n].astype(np.int64) + 1, np.zeros(7, np.int64))
        value[self.ends] = 0
        key = np.zeros(n, np.int64)
        for i in range(7):
            key = key * 257 + np.where(left > i, value[i:i + n], 0)
        tie = np.where(left < 7, owner + 1, 0)  # such a suffix ends inside the key
        order = np.lexsort((tie, key))
        fresh = np.append(True, (key[order][1:] != key[order][:-1]) | (tie[order][1:] != tie[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        width = 7
        while not fresh.all():
            ahead = np.zeros(n, np.int64)
            if width < n:
                ahead[:n - width] = rank[width:]
            pair = rank * (n + 1) + ahead
            order = np.argsort(pair)
            sorted_ = pair[order]
            fresh = np.append(True, sorted_[1:] != sorted_[:-1])
            rank[order] = np.cumsum(fresh)
            width *= 2
        return order

    def _common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at p and q, inside their texts."""
        most = np.minimum(self.stop[p] - p, self.stop[q] - q)
        words = np.lib.stride_tricks.sliding_window_view(self.text, 8)
        out = np.zeros(p.size, np.int64)
        live = np.arange(p.size)
        while live.size:
            a, b = p[live] + out[live], q[live] + out[live]
            same = words[a] == words[b]
            step = np.where(same.all(1), 8, same.argmin(1))
            out[live] += step
            live = live[(step == 8) & (out[live] < most[live])]
        return np.minimum(out, most)

    def matching(self) -> np.ndarray:
        """For every text position the longest match that starts anywhere else."""
        reach = np.zeros(self.stop.size, np.int64)
        np.maximum.at(reach, self.head_at, self.head_at + self.prefix)
        after = np.append(self.prefix[1:], 0)  # of a run's last suffix and the one after it
        np.maximum.at(reach, self.tail_at, self.tail_at + after)
        return np.maximum.accumulate(reach) - np.arange(reach.size)


def _mark_shard(rows: pa.Table, length: int) -> pa.Table:
    index = RunIndex(rows.column("body").to_pylist())
    hit = index.matching() >= length
    doc_id, th, start, weight = (rows.column(c).to_pylist() for c in ("doc_id", "th", "start", "weight"))
    out = []
    for i in (i for i, w in enumerate(weight) if w == 1):
        mine = hit[index.firsts[i]:index.ends[i]]
        if mine.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            out += [(doc_id[i], th[i], start[i] + a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
    release()
    return pa.table([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["doc_id", "th", "start", "n"])


def repeated_windows(docs: DataFrame, length: int, k: int, classes: tuple[int, ...], most: int) -> DataFrame:
    """(doc_id, th, start, n): runs of windows that also start elsewhere."""
    spark = docs.sparkSession
    found, ready, spans = [], [], None
    for level, width in enumerate(classes):
        occ = materialise(_first_spans(docs, length, k) if level == 0 else _split(_with_bodies(docs, spans), length, width),
                          "suffix-spans")
        same = materialise(occ.groupBy("key", "s1", "s2").agg(F.sum("weight").alias("c")), "suffix-same")
        # written before the join, so that Spark can split a hot anchor's rows in it
        keys = materialise(same.groupBy("key").agg(F.sum("c").alias("all"), F.count("*").alias("kinds")).filter("all > 1"), "suffix-keys")
        kept = materialise(same.join(keys.drop("all"), "key"), "suffix-kept")
        hits = materialise(occ.filter(in_bits(spark, F.col("key"), member_bits(kept, "key")))
                           .join(kept, ["key", "s1", "s2"]), "suffix-hits")
        found.append(hits.filter("c > 1").select("doc_id", "th", "start", "n"))
        if width == 1:
            break  # a key is a window: counts say all
        # one row a distinct span goes on
        once = (hits.filter("kinds > 1").groupBy("key", "s1", "s2", "kinds", F.col("c").alias("weight"))
                .agg(F.min(F.struct("doc_id", "th", "start", "n", "at")).alias("r"))
                .select("key", "weight", "kinds", "r.*"))
        once = materialise(once, "suffix-once")
        ready.append(once.filter(F.col("kinds") <= most).drop("kinds"))
        spans = once.filter(F.col("kinds") > most).drop("kinds")
        if spans.limit(1).count() == 0:
            break

    listed = ready[0]
    for more in ready[1:]:
        listed = listed.unionByName(more)

    def cut(batch: pa.RecordBatch):
        rows = []
        for ident, th, body, mine in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "body", "spans"))):
            rows += [(s["key"], ident, th, s["start"], s["weight"], body[s["start"]:s["start"] + s["n"] - 1 + length]) for s in mine]
            if len(rows) > 2_000:
                yield _cut_batch(rows)
                rows = []
        if rows:
            yield _cut_batch(rows)

    texts = materialise(map_rows(_with_bodies(docs, listed), cut,
                                 "key long, doc_id long, th long, start long, weight long, body binary", "body"), "suffix-texts")
    total = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(parts(spark), -(-total // SHARD_BYTES))
    schema = "doc_id long, th long, start long, n long"
    indexed = (texts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
               .groupBy("shard").applyInArrow(lambda rows: _mark_shard(rows, length), schema))
    for more in found:
        indexed = indexed.unionByName(more)
    return indexed


def _cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int64()) for c in cols[:5]), pa.array(list(cols[5]), pa.binary())],
                                      ["key", "doc_id", "th", "start", "weight", "body"])


def repeat_spans(rows: DataFrame, length: int = LENGTH, classes: tuple[int, ...] = CLASSES, most: int = MOST) -> DataFrame:
    """(doc_id, th, starts, ends): the maximal byte runs to remove, for the texts of (doc_id, th, body) that have any."""
    k = length - classes[0] + 1
    if k < 1 or classes[-1] != 1 or any(a % b for a, b in zip(classes, classes[1:])):
        raise ValueError("classes divide one another, begin below the length and end with 1")
    return _merged(repeated_windows(rows, length, k, classes, most), length)


def _merged(windows: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, starts, ends): the maximal runs that ``windows`` of (doc_id, th, start, n) cover."""
    def merge(batch: pa.RecordBatch):
        mine = batch.column("marks")
        row, flat = pa.compute.list_parent_indices(mine).to_numpy(), mine.flatten()
        start = flat.field("start").to_numpy()
        end = start + flat.field("n").to_numpy() - 1 + length
        apart = row * (int(end.max()) + 1)  # so that no row's runs reach the next row's
        reach = np.maximum.accumulate(end + apart)
        fresh = np.flatnonzero(np.append(True, (start + apart)[1:] > reach[:-1]))
        last = np.append(fresh[1:], start.size) - 1
        edges = pa.array(np.searchsorted(row[fresh], np.arange(batch.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"),
             *(pa.ListArray.from_arrays(edges, pa.array(x)) for x in (start[fresh], (reach - apart)[last]))],
            ["doc_id", "th", "starts", "ends"])

    marks = windows.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("marks"))
    return materialise(map_rows(marks, merge, "doc_id long, th long, starts array<long>, ends array<long>"), "suffix-marks")


# --- passages of words ---------------------------------------------------------

def _word_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's words begin (and the last one's end)."""
    found = [np.fromiter(map(xxhash.xxh3_64_intdigest, b.split() if len(b) < STRETCH else (m[0] for m in _WORD.finditer(b))), np.uint64)
             for b in bodies]
    return np.concatenate(found), np.cumsum([0, *(x.size for x in found)])


def _word_spans(of: np.ndarray, begin: np.ndarray, words: int, k: int) -> tuple[np.ndarray, ...]:
    """Spans of texts whose words follow one another: (text, first window, windows, anchor hash)."""
    first, count, at, key = anchors(of, words, k)
    text = np.searchsorted(begin, at, "right") - 1
    # windows that reach into another text go: a span's anchor lies in one text, and so do the windows that stay
    a, b = np.maximum(first, begin[text]), np.minimum(first + count, begin[text + 1] - words + 1)
    some = b > a
    return text[some], a[some], (b - a)[some], key[some]


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first, first + 1, ... of every range, and where each range begins in them (and the last one's end)."""
    edges = np.cumsum(np.append(0, count))
    return np.arange(edges[-1]) + np.repeat(first - edges[:-1], count), edges


def _span_sums(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of each span's window hashes in order."""
    at, edges = _ranges(first, count)
    x = h[at] + (at - np.repeat(first, count)).astype(np.uint64) * _STEP
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.add.reduceat(x ^ (x >> np.uint64(32)), edges[:-1])


def repeated_passages(rows: DataFrame, words: int = WORDS, k: int = WORD_GRAM) -> DataFrame:
    """(doc_id, th, starts, ends): runs of ``words`` words or more, counted in words, whose strings of ``words`` words also start
    elsewhere, the same text included; for the texts of (doc_id, th, body) that have any.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Equality rests on 64-bit hashes of strings that share the 64-bit hash of an anchor.
    """
    spark = rows.sparkSession
    names = ["doc_id", "th", "start", "n", "key", "s"]

    def spans(batch: pa.RecordBatch):
        of, begin = _word_hashes(batch.column("body").to_pylist())
        if of.size >= words:
            text, first, count, key = _word_spans(of, begin, words, k)
            if text.size:
                cols = (first - begin[text], count, key, _span_sums(_gram_hashes(of, words), first, count))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(text)) for c in names[:2]),
                                                  *(pa.array(x.view(np.int64)) for x in cols)], names)

    occ = materialise(map_rows(rows.filter(F.octet_length("body") >= 2 * words - 1), spans,
                               ", ".join(f"{c} long" for c in names), "body"), "passage-spans")
    same = materialise(occ.groupBy("key", "n", "s").agg(F.count("*").alias("c")), "passage-same")
    # written before the joins, as above
    keys = materialise(same.groupBy("key").agg(F.sum("c").alias("all"), F.count("*").alias("kinds")).filter("all > 1"), "passage-keys")
    kept = materialise(same.join(keys.drop("all"), "key"), "passage-kept")
    hits = materialise(occ.filter(in_bits(spark, F.col("key"), member_bits(keys, "key"))).join(kept, ["key", "n", "s"]), "passage-hits")
    # one row a distinct span goes on
    once = (hits.filter("kinds > 1").groupBy("key", "n", "s", F.col("c").alias("weight"))
            .agg(F.min(F.struct("doc_id", "th", "start")).alias("r")).select("key", "n", "weight", F.lit(0).alias("at"), "r.*"))

    def hashes(batch: pa.RecordBatch):
        of, begin = _word_hashes(batch.column("body").to_pylist())
        h = _gram_hashes(of, words).view(np.int64)
        mine = batch.column("spans")
        text, flat = pa.compute.list_parent_indices(mine).to_numpy(), mine.flatten()
        first, count = flat.field("start").to_numpy(), flat.field("n").to_numpy()
        at, edges = _ranges(first + begin[text], count)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pa.array(text)) for c in ("doc_id", "th")), *(flat.field(c) for c in ("start", "weight", "key")),
             pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(h[at]))],
            ["doc_id", "th", "start", "weight", "key", "hashes"])

    told = materialise(map_rows(_with_bodies(rows, materialise(once, "passage-once")), hashes,
                                "doc_id long, th long, start long, weight long, key long, hashes array<long>", "body"), "passage-hashes")
    each = told.select("doc_id", "th", "start", "weight", "key", F.posexplode("hashes").alias("i", "w"))
    twice = materialise(each.groupBy("key", "w").agg(F.sum("weight").alias("c")).filter("c > 1").select("key", "w"), "passage-windows")
    # spans of more weight are among the equal ones
    other = each.filter("weight = 1").join(twice, ["key", "w"])
    return _merged(hits.filter("c > 1").select("doc_id", "th", "start", "n").unionByName(
        other.select("doc_id", "th", (F.col("start") + F.col("i")).alias("start"), F.lit(1).cast("bigint").alias("n"))), words)


def _pieces(body: bytes, starts, ends) -> bytes:
    cuts = [0, *(x for r in zip(starts, ends) for x in r), len(body)]
    return b"".join(body[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def _each(fn, body: pa.Array, starts: pa.Array, ends: pa.Array) -> list:
    return [None if a is None or x is None else fn(_pieces(x, a, z)) for x, a, z in zip(*(c.to_pylist() for c in (body, starts, ends)))]


@F.arrow_udf(T.BinaryType())
def without(body: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """The bytes outside the runs."""
    return pa.array(_each(bytes, body, starts, ends), pa.binary())


@F.arrow_udf(T.StringType())
def without_as_text(body: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """The text outside the runs; characters that a run cuts through go with it."""
    return pa.array(_each(lambda x: x.decode("utf-8", "ignore"), body, starts, ends), pa.string())


@F.arrow_udf(T.StringType())
def without_passages(body: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """The text outside the runs of ``LENGTH`` bytes or ``WORDS`` words; shorter runs stay."""
    columns, kept = [c.to_pylist() for c in (body, starts, ends)], []
    for x, a, z in zip(*columns):
        runs = [(b, e) for b, e in zip(a or [], z or []) if x is not None and (e - b >= LENGTH or len(x[b:e].split()) >= WORDS)]
        kept.append(([b for b, _ in runs], [e for _, e in runs]))
    kind = pa.list_(pa.int64())
    return pa.array(_each(lambda x: x.decode("utf-8", "ignore"), body, *(pa.array(c, kind) for c in zip(*kept))) if kept else [], pa.string())


def _marked(rows: DataFrame, spans: DataFrame, doc_id: str, th: str, *more: str):
    """(rows without runs, rows joined with their ``starts``, ``ends`` and ``more``); only the latter are shuffled."""
    hit = in_bits(rows.sparkSession, F.col(th), member_bits(spans, "th"))
    right = spans.select(F.col("doc_id").alias("_l_d"), F.col("th").alias("_l_t"), F.col("starts").alias("_l_a"),
                         F.col("ends").alias("_l_b"), *more).hint("merge")
    # a merge join: beside the filter and the cutting, a broadcast would put two Python workers on one task
    joined = rows.filter(hit).join(right, F.col(doc_id).cast("bigint").eqNullSafe(F.col("_l_d")) & (F.col(th) == F.col("_l_t")),
                                   "left")
    return rows.filter(~hit).unionByName(joined.filter("_l_t IS NULL").select(*rows.columns)), joined.filter("_l_t IS NOT NULL")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), utf8(F.col(text)).alias("body")).withColumn(
        "th", F.xxhash64("body"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   classes: tuple[int, ...] = CLASSES, most: int = MOST, words: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (removed runs as byte offsets), kept (binary).

    With ``words``, also passages: the runs that ``repeated_passages`` finds, as word offsets.  They don't change what is removed.
    """
    rows = _rows(docs, doc_id, text)
    marks, more = repeat_spans(rows, length, classes, most), []
    kind = "array<struct<start:bigint,end:bigint>>"
    if words is not None:
        both = marks.unionByName(repeated_passages(rows, words).select(
            "doc_id", "th", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).cast(kind).alias("passages")), True)
        none = F.array().cast("array<bigint>")  # a text is at most once on either side
        marks = materialise(both.groupBy("doc_id", "th").agg(*(
            F.coalesce(F.first(c, True), x).alias(c) for c, x in (("starts", none), ("ends", none), ("passages", F.array().cast(kind))))),
            "suffix-passages")
        more = ["passages"]
    plain, cut = _marked(rows, marks, "doc_id", "th", *more)
    n = F.octet_length("body").cast("bigint").alias("n_bytes")
    whole = plain.select("doc_id", n, F.lit(0).cast("bigint").alias("n_removed"), F.array().cast(kind).alias("spans"),
                         F.col("body").alias("kept"), *(F.array().cast(kind).alias(c) for c in more))
    rest = cut.select("doc_id", n, F.arrays_zip(F.col("_l_a").alias("start"), F.col("_l_b").alias("end")).cast(kind).alias("spans"),
                      without("body", "_l_a", "_l_b").alias("kept"), *more)
    return whole.unionByName(rest.withColumn("n_removed", F.col("n_bytes") - F.octet_length("kept")))


def _stripped(docs: DataFrame, doc_id: str, text: str, outside, length: int, classes: tuple[int, ...]) -> DataFrame:
    keyed = docs.withColumn("_l_body", utf8(F.col(text))).withColumn("_l_th", F.xxhash64("_l_body"))
    spans = repeat_spans(_rows(docs, doc_id, text), length, classes)
    plain, cut = _marked(keyed, spans, doc_id, "_l_th")
    return plain.select(*docs.columns).unionByName(
        cut.withColumn(text, outside("_l_body", "_l_a", "_l_b")).select(*docs.columns))


def strip_column(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeats taken out of their text; a null text stays null."""
    return _stripped(docs, doc_id, text, without_as_text, LENGTH, CLASSES)


def strip_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without repeated passages: all that ``strip_column`` takes out, and shorter runs of ``WORDS`` words.

    Runs are made of repeated strings of ``PASSAGE`` bytes, so fifty words that take less than that stay.
    """
    return _stripped(docs, doc_id, text, without_passages, PASSAGE, PASSAGE_CLASSES)
