"""Best-fit packing planned on a length histogram.

Documents become token ids and pieces of at most ``capacity`` tokens.  Only the
histogram of piece lengths (at most ``capacity`` numbers) reaches the driver,
which runs best-fit decreasing over counts: all pieces of one length go at once
into the open sequences whose space fits tightest, and what is left opens new
ones.  The plan says, for every length, which ranks take which sequences at
which offset; pieces are ranked within their length and look their slot up.

Defined cases: a null or empty text is the end id alone.  Rows that repeat are
packed each for itself.  Null ids are kept.  Extra columns are ignored.  An
empty table gives an empty result.
"""
from __future__ import annotations

import bisect
import functools
import itertools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from lectern.llm.common import map_rows, materialise, merge_side_by_side, parts, rank_of_pairs, release, texts_of, utf8

CAPACITY, END_ID = 4096, 1
#: Words that merge side by side: lower-case letters of Latin-1, up to this many bytes.
ROW_BYTES, LETTERS = 32, "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
CACHE_WORDS, CACHE_BYTES = 400_000, 8 << 20
#: Signs behind a letter or number and before a blank are a token piece of their own, so they may stand apart
#: (a bar may end a special token).  Only for letters that normalising leaves single: others may end in a mark.
_SIGN, _SINGLE = r"[!-/:-@\[-`{}~]", "[0-9A-Za-zÀ-ÖØ-öø-įı-ſЀ-ҁ]"
SIGN = re.compile(rf"{_SIGN}(?<={_SINGLE}{_SIGN}){_SIGN}*(?=[ \n]|\Z)")


def latin(text: str) -> bool:
    """Whether all code points are Latin-1: composed already, and lowered one by one."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class WordIds:
    """Ids of a tokenizer whose tokens never cross a space, cached by space-separated chunk.

    The tokenizer lower-cases and splits off signs itself; Latin-1 texts are
    lowered and signs behind words set apart before the lookup, which changes
    no id and lets more chunks share an entry.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side already
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 24 | vocab[b] for a, b in merges], np.int64)
        self.order = np.argsort(key)
        self.keys, self.merged = key[self.order], np.array([vocab[a + b] for a, b in merges], np.int64)
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)  # id of a byte, of a word's last byte
        for c in LETTERS:
            for byte, sign in zip(c.encode(), spell(c)[0][0]):
                self.inner[byte], self.last[byte] = vocab[sign], vocab[sign + end]
        self.forget()

    def merge_plain(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of ``LETTERS``: their merges need no splitting or normalising."""
        width = max(map(len, words))
        n = np.array([len(w) for w in words])
        at = np.frombuffer(b"".join(w.ljust(width, b"a") for w in words), np.uint8).reshape(-1, width)
        ids = np.pad(self.inner[at], ((0, 0), (0, 1)))
        every = np.arange(len(words))
        ids[every, n - 1] = self.last[at[every, n - 1]]
        return merge_side_by_side(ids, n, lambda a, b: rank_of_pairs(self.keys, self.order, a, b), self.merged)

    def learn(self, new: pa.Array) -> None:
        """Keep the ids of distinct words."""
        size = pa.compute.binary_length(new)
        short = pa.compute.and_(pa.compute.match_substring_regex(new, f"^[{LETTERS}]+$"), pa.compute.less_equal(size, ROW_BYTES))
        rest = new.filter(pa.compute.invert(short)).to_pylist()
        some = new.filter(short)
        some = some.take(pa.compute.sort_indices(size.filter(short)))
        plain, spelled = some.to_pylist(), some.cast(pa.large_binary()).to_pylist()
        found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        for a in range(0, len(plain), 4096):
            found += self.merge_plain(spelled[a:a + 4096])
        self.seen.update(zip(rest + plain, range(len(self.at) - 1, len(self.at) - 1 + len(found))))
        ends = np.cumsum([len(ids) for ids in found]) + len(self.flat)
        self.at.frombytes(ends.astype(np.int64).tobytes())
        self.flat.extend(itertools.chain.from_iterable(found))
        self.bytes += pa.compute.sum(size).as_py()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.bytes = 0
        self.flat, self.at = array("q"), array("q", [0])

    def ids(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """Ids of every text, followed by ``end_id``."""
        if len(self.seen) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.forget()
        spaced = [SIGN.sub(r" \g<0>", t.lower() if latin(t) and "<|" not in t else t).replace("\n", " ") for t in texts]
        split = pa.compute.split_pattern(pa.array(spaced, pa.large_string()), " ")
        sizes = pa.compute.list_value_length(split).to_numpy()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()  # each word of the batch once
        where = list(map(self.seen.get, words))
        if None in where:
            self.learn(coded.dictionary.filter(pa.array([i is None for i in where], pa.bool_())))
            where = list(map(self.seen.__getitem__, words))
        at, flat = np.frombuffer(self.at, np.int64), np.frombuffer(self.flat, np.int64) if self.flat else np.zeros(0, np.int64)
        where = np.array(where, np.int64)[coded.indices.to_numpy()]
        counts = at[where + 1] - at[where]
        before = np.cumsum(counts) - counts
        ids = flat[np.repeat(at[where] - before, counts) + np.arange(int(counts.sum()))]
        ends = np.append(before, ids.size)[np.cumsum(sizes)]
        del at, flat
        return [np.append(ids[a:b], end_id) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    found = WordIds(path)
    release()  # what the vocabulary file left behind
    return found


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, keep_words: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids as little-endian unsigned 32-bit numbers.

    ``keep_words``: workers keep the words they learned from one task to the next (``CACHE_WORDS`` at most);
    otherwise every task learns them anew and its memory is free for what runs after it.
    """
    def run(batch: pa.RecordBatch):
        found = word_ids(path).ids(texts_of(batch.column("body")), end_id)
        out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
        for d, ids in zip(batch.column("doc_id").to_pylist(), found):
            for i, a in enumerate(range(0, ids.size, capacity)):
                part = ids[a:a + capacity]
                for k, v in zip(out, (d, i, a, part.size, part.astype("<u4").tobytes())):
                    out[k].append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), utf8(F.col(text)).alias("body"))
    return map_rows(rows, run, "doc_id long, piece int, start long, length long, ids binary", "body",
                    after=None if keep_words else lambda: word_ids(path).forget())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Best-fit decreasing over counts.

    Rows sorted by (length, rank): pieces of ``length`` with rank from ``rank``
    on take sequence ``sequence``, ``sequence + 1``, ... at ``offset``.
    """
    spaces: list[int] = []  # sorted spaces of open sequences
    open_at: dict[int, list[tuple[int, int]]] = {}  # space -> ranges (first sequence, count)
    rows, used = [], 0

    def leave(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in open_at:
                bisect.insort(spaces, space)
                open_at[space] = []
            open_at[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(space: int, first: int, count: int, each: int) -> None:
            nonlocal rank, left
            for j in range(each):
                rows.append((length, rank, first, capacity - space + j * length))
                rank += count
                left -= count
            leave(space - each * length, first, count)

        while left:
            k = bisect.bisect_left(spaces, length)
            if k == len(spaces):
                each = capacity // length
                count = max(1, left // each)
                fill(capacity, used, count, min(each, left))
                used += count
                continue
            space = spaces[k]
            first, count = open_at[space].pop()
            if not open_at[space]:
                del open_at[space]
                spaces.pop(k)
            each = min(space // length, left)
            take = min(count, max(1, left // each))
            leave(space, first + take, count - take)
            fill(space, first, take, each)
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return {"length": cols[0], "rank": cols[1], "sequence": cols[2], "offset": cols[3]}


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add (sequence_id, offset) to a table with a bigint ``length`` between 1 and ``capacity``."""
    spark = found.sparkSession
    salts = max(64, parts(spark))
    # a length may hold a third of all pieces: it is ranked in ``salts`` parts
    rows = materialise(found.withColumn("_l_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))), "pieces")
    cells = rows.groupBy("length", "_l_salt").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    if not histogram:
        return rows.drop("_l_salt").withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")})
    if min(histogram) < 1 or max(histogram) > capacity:
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    slots = spark.sparkContext.broadcast(plan(histogram, capacity))

    upto = Window.partitionBy("length").orderBy("_l_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0))).select("length", "_l_salt", "base")
    inside = Window.partitionBy("length", "_l_salt").orderBy(F.monotonically_increasing_id())
    ranked = (rows.withColumn("_l_row", F.row_number().over(inside)).join(base, ["length", "_l_salt"])
              .withColumn("_l_rank", F.col("_l_row") + F.col("base") - 1).drop("_l_salt", "_l_row", "base"))

    def place(batch: pa.RecordBatch):
        p = slots.value
        length, rank = (batch.column(c).to_numpy() for c in ("length", "_l_rank"))
        # lengths and ranks as one sorted key
        step = int(max(p["rank"].max(), rank.max())) + 1
        at = np.searchsorted(p["length"] * step + p["rank"], length * step + rank, side="right") - 1
        out = batch.drop_columns(["_l_rank"])
        out = out.append_column("sequence_id", pa.array(p["sequence"][at] + rank - p["rank"][at]))
        yield out.append_column("offset", pa.array(p["offset"][at]))

    kinds = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "_l_rank")
    return map_rows(ranked, place, f"{kinds}, sequence_id long, offset long")
