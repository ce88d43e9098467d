"""Byte-level BPE encoding and decoding on Arrow batches.

Pre-tokenisation uses no regex.  Every code point becomes a class, and a small
automaton over (state, class) says where a pre-token begins.  Its transition
functions form a finite monoid, and composing them is associative, so a batch
is cut into lanes that are scanned side by side: prefix compositions inside
each lane, then a doubling scan over the lanes' totals, then one lookup that
turns every prefix into a state.  The slices between boundaries look up the ids
of their merges in a bounded cache; only unseen slices run the pair merging.

Per document the ids are kept with the byte offset at which each token starts;
decoding copies each token's bytes to its offset.

Defined cases: a null text is the empty text (no ids, no bytes).  Rows that
repeat are encoded each for itself.  Bytes that aren't UTF-8 are read as
U+FFFD.  Extra columns are not returned.  An empty table gives an empty result.
"""
from __future__ import annotations

import base64
import functools
import heapq
import itertools
from array import array

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_rows, merge_side_by_side, rank_of_pairs, texts_of, utf8

# Classes of code points; the last ones depend on what follows.
LETTER, NUMBER, OTHER, BLANK_ON, BLANK_LAST, SPACE_LAST, QUOTE_2, QUOTE_3, BREAK = range(9)
# States: what the token in progress may take next.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
#: Slices, and their code points together, that a worker's cache may hold before it starts anew.
CACHE_SLICES, CACHE_CHARS = 300_000, 4 << 20
#: Up to this many bytes unseen slices merge side by side, beyond it one by one through a heap.
ROW_BYTES = 32


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """step[class, state] -> state, begins[state, class] -> whether a token begins."""
    step = np.zeros((9, 8), np.uint8)
    begins = np.ones((8, 9), bool)
    for kind, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        step[kind] = inside
        for state in (inside, AFTER_SPACE):
            begins[state, kind] = False
    step[LETTER, TWO_MORE], step[LETTER, ONE_MORE] = ONE_MORE, FREE
    begins[TWO_MORE, LETTER] = begins[ONE_MORE, LETTER] = False
    for kind, rest in ((QUOTE_2, ONE_MORE), (QUOTE_3, TWO_MORE)):
        step[kind] = rest
        for state in (IN_OTHERS, AFTER_SPACE):  # the quote belongs to a run of signs
            step[kind, state], begins[state, kind] = IN_OTHERS, False
    step[BLANK_ON] = IN_BLANKS
    begins[IN_BLANKS, BLANK_ON] = False
    step[BLANK_LAST] = FREE
    step[SPACE_LAST] = AFTER_SPACE
    step[BREAK] = FREE
    return step, begins


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, product[a, b] = first a then b, image[element, state])."""
    step, _ = _rules()
    found = {tuple(range(8)): 0}
    todo = list(found)
    while todo:
        f = todo.pop()
        for c in range(9):
            g = tuple(int(step[c, s]) for s in f)
            if g not in found:
                found[g] = len(found)
                todo.append(g)
    image = np.array(list(found), np.uint8)
    product = np.array([[found[tuple(int(b[s]) for s in a)] for b in image] for a in image], np.uint8)
    return np.array([found[tuple(int(x) for x in step[c])] for c in range(9)], np.uint8), product, image


@functools.cache
def _code_classes() -> np.ndarray:
    """Class of every code point, as the library that defines the encoding sees it.

    An encoding of single bytes whose pattern is one class emits exactly the
    members of that class.
    """
    ranks = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK_ON)):
        enc = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for a in range(0, 0x110000, 0x800):  # a block of surrogates falls on whole steps
            if not 0xD800 <= a < 0xE000:
                found = bytes(enc.encode_ordinary("".join(map(chr, range(a, a + 0x800)))))
                out[np.frombuffer(found.decode("utf-8").encode("utf-32-le"), np.uint32)] = kind
    return out


def _classes(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    kind = _code_classes()[codes]
    kind[breaks] = BREAK
    after = np.append(kind[1:], BREAK)
    last = (kind == BLANK_ON) & (after != BLANK_ON) & (after != BREAK)
    space = codes == 0x20
    at = np.flatnonzero((codes == 0x27) & (after == LETTER))
    if at.size:
        padded = np.append(codes, [0, 0]).astype(np.uint32)
        one = padded[at + 1]
        two = np.where(np.append(kind, [BREAK, BREAK])[at + 2] == LETTER, padded[at + 2], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kind[at[short]] = QUOTE_2
        kind[at[long]] = QUOTE_3
    kind[last] = np.where(space[last], SPACE_LAST, BLANK_LAST)
    return kind


def token_starts(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; ``breaks`` marks the marks between texts."""
    n = codes.size
    if n == 0:
        return np.zeros(0, bool)
    element, product, image = _monoid()
    kind = _classes(codes, breaks)
    width = max(1, int(np.sqrt(n) * 2))
    length = -(-n // width)
    grid = np.full(length * width, element[BREAK], np.uint8)
    grid[:n] = element[kind]
    grid = np.ascontiguousarray(grid.reshape(width, length).T)  # row i: the i-th code point of every lane
    for i in range(1, length):
        grid[i] = product[grid[i - 1], grid[i]]
    total, hop = grid[-1].copy(), 1
    while hop < width:  # inclusive scan over lanes by doubling
        total[hop:] = product[total[:-hop], total[hop:]]
        hop *= 2
    entry = np.full(width, FREE, np.uint8)
    entry[1:] = image[total[:-1], FREE]
    state = image[grid, entry].T.reshape(-1)[:n]  # after each code point
    before = np.empty(n, np.uint8)
    before[0], before[1:] = FREE, state[:-1]
    out = _rules()[1][before, kind]
    out[breaks] = False
    return out


class _Cache:
    """Ids of slices, one behind another."""

    def __init__(self):
        self.seen: dict[str, int] = {}
        self.chars = 0
        self.flat, self.at = array("i"), array("q", [0])

    def add(self, slices: list[str], ids: list[int], counts: list[int]) -> None:
        self.seen.update(zip(slices, range(len(self.at) - 1, len(self.at) - 1 + len(slices))))
        self.chars += sum(map(len, slices))
        self.at.frombytes((np.cumsum(counts, dtype=np.int64) + len(self.flat)).tobytes())
        self.flat.extend(ids)

    def ids(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not where.size:
            return np.zeros(0, np.int64), where
        at, flat = np.frombuffer(self.at, np.int64), np.frombuffer(self.flat, np.int32)
        counts = at[where + 1] - at[where]
        return flat[_spread(at[where], counts)].astype(np.int64), counts


class Vocabulary:
    """Ranks of a public rank file, with the bytes of all ids in one array."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.young, self.old = _Cache(), _Cache()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the adjacent pair of lowest rank merges first, leftmost among equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that begins here
        prev, alive = list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue  # one of the two parts has merged otherwise
            alive[j], end[i] = False, stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := prev[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    @functools.cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys of the pairs whose bytes together are a token, its rank, rank of each byte)."""
        get, found = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None:
                    found[a << 24 | b] = rank
        keys = np.sort(np.fromiter(found, np.int64, len(found)))
        return keys, np.array([found[k] for k in keys.tolist()], np.int64), np.array(
            [self.ranks[bytes([i])] for i in range(256)], np.int64)

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return rank_of_pairs(*self._pairs[:2], left, right)

    def merge_rows(self, pieces: list[bytes]) -> list[list[int]]:
        """``merge`` for short slices of about one length: every round merges one pair in each row."""
        width = max(map(len, pieces))
        n = np.array([len(p) for p in pieces])
        ids = self._pairs[2][np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)].reshape(-1, width)
        ids = np.pad(ids, ((0, 0), (0, 1)))
        return merge_side_by_side(ids, n, self._pair_rank)

    def _learn(self, new: pa.Array) -> None:
        """Ids of distinct slices go into the young generation."""
        raw = new.cast(pa.large_binary()).to_pylist()
        ranks = list(map(self.ranks.get, raw))
        found = [None if r is None else [r] for r in ranks]
        rest = [i for i, r in enumerate(ranks) if r is None]
        sizes = np.array([len(raw[i]) for i in rest], np.int64)
        order = np.argsort(sizes, kind="stable")
        short = np.array(rest, np.int64)[order[:int((sizes <= ROW_BYTES).sum())]].tolist()
        for a in range(0, len(short), 4096):
            part = short[a:a + 4096]
            for i, ids in zip(part, self.merge_rows([raw[i] for i in part])):
                found[i] = ids
        for i in rest:
            if found[i] is None:
                found[i] = self.merge(raw[i])
        self.young.add(new.to_pylist(), list(itertools.chain.from_iterable(found)), [len(x) for x in found])

    def encode_slices(self, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices in order, number of ids of each); every distinct slice is looked up once.

        The cache has two generations: slices met again move into the young one, and the old one is dropped when that is full.
        """
        if len(self.young.seen) > CACHE_SLICES or self.young.chars > CACHE_CHARS:
            self.young, self.old = _Cache(), self.young
        slices = coded.dictionary.to_pylist()
        where = list(map(self.young.seen.get, slices))
        unseen = [i for i, w in enumerate(where) if w is None]
        if unseen:
            before = [self.old.seen.get(slices[i]) for i in unseen]
            again = [(i, w) for i, w in zip(unseen, before) if w is not None]
            if again:
                ids, counts = self.old.ids(np.array([w for _, w in again], np.int64))
                self.young.add([slices[i] for i, _ in again], ids.tolist(), counts.tolist())
            new = [i for i, w in zip(unseen, before) if w is None]
            if new:
                self._learn(coded.dictionary.take(pa.array(new)))
            where = list(map(self.young.seen.__getitem__, slices))
        return self.young.ids(np.array(where, np.int64)[coded.indices.to_numpy()])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of every id copied to its offset."""
        if ids.size == 0:
            return b""
        n = self.length[ids]
        out = np.empty(int(offsets[-1] + n[-1]), np.uint8)
        out[_spread(offsets, n)] = self.bytes[_spread(self.start[ids], n)]
        return out.tobytes()


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count numbers each."""
    total = int(counts.sum())
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(texts: list[str], vocab: Vocabulary) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, byte offset of each token) for every text."""
    joined = "\n".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    breaks = (np.cumsum(sizes + 1) - 1)[:-1]
    starts = np.flatnonzero(token_starts(codes, breaks))
    owner = np.searchsorted(np.append(0, breaks + 1), starts, side="right") - 1
    # slices lie one behind another in the texts without the marks between them
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    width[breaks] = 0
    before = np.append(0, np.cumsum(width))
    data = "".join(texts).encode("utf-8")
    edges = np.append(before[starts], len(data)).astype(np.int64)
    slices = pa.LargeStringArray.from_buffers(starts.size, pa.py_buffer(edges), pa.py_buffer(data))
    ids, counts = vocab.encode_slices(slices.dictionary_encode()) if starts.size else (np.zeros(0, np.int64),) * 2
    per_text = np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)
    out, a = [], 0
    for n in per_text.tolist():
        mine = ids[a:a + n]
        out.append((mine, np.cumsum(vocab.length[mine]) - vocab.length[mine]))
        a += n
    return out


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", packed: bool = False) -> DataFrame:
    """(doc_id, ids, offsets): token ids and the byte offset of each token in the text.

    As array<int> and array<bigint>, or ``packed`` as binary (little-endian
    unsigned 32-bit numbers, a text has less than 2 GiB), which is cheaper to move.
    """
    def run(batch: pa.RecordBatch):
        vocab = vocabulary(path)
        found = encode_texts(texts_of(batch.column("body")), vocab)
        if packed:
            ids = pa.array([a.astype("<u4").tobytes() for a, _ in found], pa.binary())
            offsets = pa.array([o.astype("<u4").tobytes() for _, o in found], pa.binary())
        else:
            ids = pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32()))
            offsets = pa.array([o for _, o in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, offsets], ["doc_id", "ids", "offsets"])

    kind = "ids binary, offsets binary" if packed else "ids array<int>, offsets array<bigint>"
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), utf8(F.col(text)).alias("body"))
    return map_rows(rows, run, f"doc_id long, {kind}", "body", after=lambda: vocabulary(path).forget())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of an ``encode`` result, packed or not; null ids are no bytes."""
    packed = dict(encoded.dtypes)["ids"] == "binary"

    def run(batch: pa.RecordBatch):
        vocab, out = vocabulary(path), []
        for ids, offsets in zip(batch.column("ids").to_pylist(), batch.column("offsets").to_pylist()):
            if packed:
                a, o = np.frombuffer(ids or b"", "<u4").astype(np.int64), np.frombuffer(offsets or b"", "<u4").astype(np.int64)
            else:
                a, o = np.array(ids or [], np.int64), np.array(offsets or [], np.int64)
            out.append(vocab.decode(a, o))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.binary())],
                                         ["doc_id", "ids", "decoded"])

    kind = "binary" if packed else "array<int>"
    return map_rows(encoded.select("doc_id", "ids", "offsets"), run, f"doc_id long, ids {kind}, decoded binary",
                    "ids" if packed else None)
