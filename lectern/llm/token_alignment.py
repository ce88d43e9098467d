"""Alignment of two tokenizers over the same bytes.

A text is encoded as a space and itself by a byte-level BPE (A) and as itself
by a piece model that adds the space (B).  Both spell the same bytes, so every
token is a byte range.

Method: per batch, ``merge_asof`` finds for each token start the covering token
of the other side, keyed by document: the documents of a batch lie one behind
another on one axis, each beginning with a token of both sides, so the nearest
start at or before a token is in its own document.  The union of both directions
gives all overlapping pairs; byte ends that both sides share cut the tokens into
groups.

Corpus counts: each task adds up its id pairs before the shuffle.  Up to
``BROADCAST_PAIRS`` counted pairs are broadcast as sorted arrays; more of them
are joined with the pairs of the documents, whose skew Spark splits.

Speed: texts whose code points are all in ``PLAIN`` go to A through tiktoken with
the ranks and the pattern of the same file; there both split alike (tested code
point by code point).  Other texts go through the file's own tokenizer.

Texts that are null, empty, or whose tokens spell other bytes (broken UTF-8,
U+2581, unknown pieces) have no tokens: zeros and ''.  Rows are documents, so
repeated rows count once each.  An empty table gives an empty result.
Other columns are not read.
"""
from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm.common import cut_batch, map_rows, materialise, utf8

#: Text bytes handled at once, pairs a task adds up before it sends them on, counted pairs that may be broadcast.
CHUNK_BYTES, BUFFER_PAIRS, BROADCAST_PAIRS = 1 << 20, 1 << 20, 1 << 22
#: Texts of these code points alone are split by the pattern below exactly as by the tokenizer.
PLAIN = re.compile("[\x00-ɏ‐-‧]*")
# Fixed value: the pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def layout(path_a: str, path_b: str) -> tuple[int, str]:
    """Pairs are ``a * n_b + b``: (n_b, the type that holds them all)."""
    n_a, n_b = Tokenizer.from_file(path_a).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    return n_b, "<u4" if n_a * n_b <= 1 << 32 else "<i8"


class ByteLevelSide:
    """Side A: ids of `` `` + text and the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        ranks = {}
        for sign, i in vocab.items():
            if all(x in byte_of for x in sign):
                self.bytes[i] = bytes(byte_of[x] for x in sign)
                ranks[self.bytes[i]] = i
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        for s in special:
            i = vocab.get(s)
            if i is not None:
                self.bytes[i] = s.encode()
                ranks.pop(s.encode(), None)
        self.fast = tiktoken.Encoding("side-a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if PLAIN.fullmatch(t):
                out[i] = self.fast.encode_ordinary(" " + t)
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([" " + texts[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out


class PieceSide:
    """Side B: ids of text by a model that adds the space, and the bytes of each id."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevelSide(path_a), PieceSide(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in s.bytes], np.int64) for s in (self.a, self.b))
        # decimal ids with what follows them: "," inside a side of a group, "|" after its A ids, ";" after its B ids
        self.text_a = np.array([f"{i},".encode() for i in range(len(self.a.bytes))] + [f"{i}|".encode() for i in range(len(self.a.bytes))], object)
        self.text_b = np.array([f"{i},".encode() for i in range(len(self.b.bytes))] + [f"{i};".encode() for i in range(len(self.b.bytes))], object)

    def align(self, raw: list[bytes | None]) -> dict[str, np.ndarray | list]:
        """Figures of each text, and its distinct pairs with their uses."""
        body = [b" " + (x or b"") for x in raw]
        texts = [(x or b"").decode("utf-8", "replace") for x in raw]
        ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
        for i, (x, a, b) in enumerate(zip(body, ids_a, ids_b)):
            if (len(x) == 1 or b"".join(map(self.a.bytes.__getitem__, a)) != x or b"".join(map(self.b.bytes.__getitem__, b)) != x):
                ids_a[i] = ids_b[i] = []
        n = len(raw)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        if not n_a.any():
            none = np.zeros(n, np.int64)
            return {"n_a": none, "n_b": none, "n_groups": none, "n_links": none, "groups": [b""] * n, "pairs": none[:0], "uses": none[:0], "distinct": none}
        a, b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(c.sum())) for ids, c in ((ids_a, n_a), (ids_b, n_b)))
        doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])  # texts lie one behind another
        start_a, start_b = end_a - self.size_a[a], end_b - self.size_b[b]
        left = pd.DataFrame({"at": start_a, "doc": doc_a, "i": np.arange(a.size)})
        right = pd.DataFrame({"at": start_b, "doc": doc_b, "j": np.arange(b.size)})
        covers_a = pd.merge_asof(left, right, on="at", by="doc")["j"].to_numpy(np.int64)  # B token over each A token's start
        covers_b = pd.merge_asof(right, left, on="at", by="doc")["i"].to_numpy(np.int64)
        inner = start_b[covers_a] != start_a  # equal starts are found from both sides
        i, j = np.append(np.flatnonzero(inner), covers_b), np.append(covers_a[inner], np.arange(b.size))
        # distinct pairs of each document
        n_pairs = len(self.a.bytes) * len(self.b.bytes)
        links = np.sort(doc_a[i] * n_pairs + a[i] * len(self.b.bytes) + b[j])
        first = np.flatnonzero(np.append(True, links[1:] != links[:-1]))
        uses = np.diff(np.append(first, links.size))
        # groups: byte ends that both sides share
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[:a.size], np.append(group_b[1:] != group_b[:-1], True)[:b.size]
        in_a, in_b = np.bincount(group_a, minlength=both.size), np.bincount(group_b, minlength=both.size)
        before_b = np.cumsum(in_b) - in_b
        upto_a = np.cumsum(in_a)
        spelled = np.empty(a.size + b.size, object)
        spelled[np.arange(a.size) + before_b[group_a]] = self.text_a[a + last_a * len(self.a.bytes)]
        spelled[np.arange(b.size) + upto_a[group_b]] = self.text_b[b + last_b * len(self.b.bytes)]
        ends = np.cumsum(n_a + n_b)
        spelled = spelled.tolist()
        groups = [b"".join(spelled[z - k:z])[:-1] for z, k in zip(ends.tolist(), (n_a + n_b).tolist())]
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_a[last_a], minlength=n), "n_links": np.bincount(links // n_pairs, minlength=n),
                "groups": groups, "pairs": links[first] % n_pairs, "uses": uses, "distinct": np.bincount(links[first] // n_pairs, minlength=n)}


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, uses) of every document.

    ``groups``: ``a1,a2|b1;a3|b2,b3`` (``digest``: its SHA-256); ``pairs``: distinct id pairs, ascending and in the type of
    ``layout``, ``uses``: how many links have them (unsigned 32 bits).
    """
    _, kind = layout(path_a, path_b)
    counts = ("n_a", "n_b", "n_groups", "n_links")

    def run(batch: pa.RecordBatch):
        got = aligner(path_a, path_b).align(batch.column("body").to_pylist())
        groups = [g.decode() for g in got["groups"]]
        if digest:
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        cut = np.cumsum(got["distinct"])[:-1]
        bodies = [[x.tobytes() for x in np.split(v, cut)] for v in (got["pairs"].astype(kind), got["uses"].astype("<u4"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(got[k].astype(np.int64)) for k in counts), pa.array(groups, pa.string()),
             *(pa.array(x, pa.binary()) for x in bodies)], ["doc_id", *counts, "groups", "pairs", "uses"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), utf8(F.col(text)).alias("body"))
    return map_rows(rows, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, uses binary",
                    "body", CHUNK_BYTES)


def pair_counts(found: DataFrame, n_b: int, kind: str) -> DataFrame:
    """(a_id, b_id, n_docs, best): documents that hold a pair linked; ``best``: no other pair of its A id is in more."""
    def run(batches):
        held, waiting = [], 0

        def flush():
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for x in batch.column("pairs").to_pylist():
                held.append(np.frombuffer(x, kind))
                waiting += held[-1].size
                if waiting >= BUFFER_PAIRS:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    summed = found.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n_docs"))
    b_id = F.col("pair") % n_b
    pairs = materialise(summed.select(((F.col("pair") - b_id) / n_b).cast("bigint").alias("a_id"), b_id.alias("b_id"), "n_docs"), "pair-counts")
    top = pairs.groupBy("a_id").agg(F.max("n_docs").alias("top"))
    return pairs.join(top, "a_id").select("a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def score(found: DataFrame, counts: DataFrame, n_b: int, kind: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``found`` (without pairs and uses) with n_best and count_sum, from the written ``counts``."""
    rest = [c for c in found.columns if c not in ("pairs", "uses")]
    keyed = counts.select((F.col("a_id") * n_b + F.col("b_id")).alias("pair"), "n_docs", "best")
    if counts.count() > broadcast_pairs:
        return _score_joined(found, keyed, rest, kind)
    held = keyed.toPandas().sort_values("pair")
    shared = found.sparkSession.sparkContext.broadcast((held["pair"].to_numpy(np.int64), held["n_docs"].to_numpy(np.int64), held["best"].to_numpy(bool)))

    def run(batches):
        key, n_docs, best = shared.value
        for batch in batches:
            for piece in cut_batch(batch, "pairs", 4 * CHUNK_BYTES):
                lists = piece.column("pairs").to_pylist()
                pair = np.frombuffer(b"".join(lists), kind).astype(np.int64)
                uses = np.frombuffer(b"".join(piece.column("uses").to_pylist()), "<u4").astype(np.int64)
                at = np.searchsorted(key, pair)  # every pair was counted
                ends = np.append(0, np.cumsum([len(x) for x in lists])) // np.dtype(kind).itemsize
                sums = [np.diff(np.append(0, np.cumsum(v))[ends]) for v in (np.where(best[at], uses, 0), n_docs[at] * uses)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in rest), *map(pa.array, sums)], [*rest, "n_best", "count_sum"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in rest] + ["n_best long, count_sum long"])
    return found.mapInArrow(run, schema)


def _score_joined(found: DataFrame, keyed: DataFrame, rest: list[str], kind: str) -> DataFrame:
    numbered = materialise(found.withColumn("_row", F.monotonically_increasing_id()), "aligned-rows")

    def split(batches):
        for batch in batches:
            for piece in cut_batch(batch, "pairs", 4 * CHUNK_BYTES):
                lists = piece.column("pairs").to_pylist()
                row = np.repeat(piece.column("_row").to_numpy(), [len(x) // np.dtype(kind).itemsize for x in lists])
                pair, uses = np.frombuffer(b"".join(lists), kind), np.frombuffer(b"".join(piece.column("uses").to_pylist()), "<u4")
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(pair.astype(np.int64)), pa.array(uses.astype(np.int64))], ["_row", "pair", "uses"])

    links = numbered.select("_row", "pairs", "uses").mapInArrow(split, "_row long, pair long, uses long")
    sums = links.join(keyed, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("uses")).otherwise(0)).alias("n_best"),
                                                        F.sum(F.col("n_docs") * F.col("uses")).alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return numbered.join(sums, "_row", "left").select(*rest, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def alignment(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", digest: bool = True,
              broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Every document's alignment with the corpus counts of its links."""
    shape = layout(path_a, path_b)
    found = materialise(align(docs, path_a, path_b, doc_id, text, digest), "alignment")
    return score(found, materialise(pair_counts(found, *shape), "pairs"), *shape, broadcast_pairs)
