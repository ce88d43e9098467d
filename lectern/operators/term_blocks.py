"""Sparse exact scoring over blocks of term vectors (survey F2, F4, F5, F10).

A block holds the term counts of some thousand texts, term by term: the terms
of the block, and for each of them the rows that have it and how often.  Blocks
are cut in the workers while the chunks stream past, so neither tokens nor
postings are exploded or shuffled.  A text's vector is its counts divided by
their Euclidean norm.

Scoring: blocks of questions are broadcast in batches of ``BATCH_BYTES`` (their
written size is summed first, every batch is one pass over the corpus, none is
left out).  For a block of questions and one of the corpus

* the rows of both are put into groups of alike vectors; a term's largest weight
  in a group bounds what a question can reach there, and questions whose bound is
  under their k-th best score so far are left out;
* a group of questions meets a group of rows: terms that many of both hold go
  through a matrix product, terms that many rows hold are added as lines over the
  rows, the postings of the others are paired.  All in single precision: a score
  that comes within its error of the k-th best is computed again in double precision;
* only candidates (scores not under the question's k-th best so far) leave the
  worker, about ``k`` a question and task.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, release
from .vectors import SCORE_DIGITS, TOP_K, normalize_lemma, rank_top_k

SCHEMA = "block long, n int, key1 binary, key2 binary, terms array<string>, starts binary, rows binary, counts binary"
#: Texts and text bytes of a block at most; the same for questions.
CORPUS_ROWS, CORPUS_BYTES, QUESTION_ROWS, QUESTION_BYTES = 4096, 4 << 20, 4096, 1 << 20
#: Pairs of postings, scores and terms that are spelled out at once: what a worker holds does not depend on how alike the rows are.
PAIRS = 1 << 19
#: Bytes of question blocks that are broadcast together, corpus rows scored at once.
BATCH_BYTES, STRIDE = 16 << 20, 4096
#: A term goes through the matrix product where more than one of this many pairs of a question and a row share it.
RARE = 300
#: A term is spelled out over the rows where more than one of ``LINED`` rows has it, unless it is in more than one of ``SHARED`` questions.
LINED, SHARED = 50, 11
#: Scores that are made together, pairs of postings that are spread over them at once, and the least score.
STRIP, SPREAD, TINY = 1 << 18, 1 << 14, 1e-30
#: Groups of alike rows of a block, the frequent terms by which they are told apart, the rounds that move rows between them, and
#: the part of the rows that a group has at least.
GROUPS, MARKS, ROUNDS, SMALL, ALIKE = 8, 64, 3, 32, 0.7


def term_blocks(texts: DataFrame, key1: str, key2: str | None, text: str, lemma_map: Column | None = None,
                rows: int = CORPUS_ROWS, size: int = CORPUS_BYTES) -> DataFrame:
    """Blocks of the term counts of ``texts``; a text without a term is in its block, with no posting."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    def block(number, k1, k2, norm):
        k1, k2, norm = (x[0] if len(x) == 1 else pa.concat_arrays(x) for x in (k1, k2, norm))
        split = pc.split_pattern(norm.cast(pa.large_string()), " ")
        at = np.repeat(np.arange(len(norm)), pc.list_value_length(split).to_numpy())
        flat = split.flatten()
        kept = pc.not_equal(flat, "")
        at, coded = at[kept.to_numpy(zero_copy_only=False)], flat.filter(kept).dictionary_encode()
        key, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * len(norm) + at, return_counts=True)
        term, row = key // max(1, len(norm)), key % max(1, len(norm))
        starts = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
        binary = [np.asarray(x, t).tobytes() for x, t in ((k1.to_numpy(), "<i8"), (k2.to_numpy(), "<i8"), (starts, "<i4"), (row, "<i4"), (counts, "<i4"))]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([len(norm)], pa.int32()), *(pa.array([x], pa.binary()) for x in binary[:2]),
             pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string())), *(pa.array([x], pa.binary()) for x in binary[2:])],
            ["block", "n", "key1", "key2", "terms", "starts", "rows", "counts"])

    def run(batches):
        part, made, n, held, waiting = TaskContext.get().partitionId(), 0, 0, 0, ([], [], [])
        for batch in batches:
            sizes, first = pc.utf8_length(batch.column("norm")).to_pylist(), 0
            for i in range(batch.num_rows + 1):
                full = i < batch.num_rows and n and (n == rows or held + sizes[i] > size)
                if (full or i == batch.num_rows) and first < i:
                    for x, c in zip(waiting, ("k1", "k2", "norm")):
                        x.append(batch.column(c)[first:i])
                    first = i
                if full:
                    yield block((part << 32) + made, *waiting)
                    made, n, held, waiting = made + 1, 0, 0, ([], [], [])
                    release()
                if i < batch.num_rows:
                    n, held = n + 1, held + sizes[i]
        if n:
            yield block((part << 32) + made, *waiting)
        waiting = None
        release()

    bound_batches(texts.sparkSession)
    second = F.col(key2).cast("bigint") if key2 else F.lit(0).cast("bigint")
    return texts.select(F.col(key1).cast("bigint").alias("k1"), second.alias("k2"),
                        normalize_lemma(text, lemma_map).alias("norm")).filter("k1 is not null").mapInArrow(run, SCHEMA)


def question_blocks(questions: DataFrame, key: str = "qid", text: str = "question", lemma_map: Column | None = None) -> DataFrame:
    return term_blocks(questions, key, None, text, lemma_map, QUESTION_ROWS, QUESTION_BYTES)


def with_lemmas(blocks: DataFrame, memo: DataFrame) -> DataFrame:
    """Blocks whose terms are replaced by their lemma in ``memo`` (form, lemma); unknown forms stay.

    The memo meets the distinct terms of each block, not the tokens; a block's
    terms that share a lemma become one.  The changed terms of a block come to
    the worker as rows right before it, so nothing is collected in one value.
    ``blocks`` is a written table.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def lemmatised(batch, at, changed):
        """Row ``at`` of ``batch`` over the lemmas; ``changed``: (place, lemma) of its terms."""
        n, terms = batch.column("n")[at].as_py(), batch.column("terms")[at].values
        starts, rows, counts = (np.frombuffer(batch.column(c)[at].as_buffer(), "<i4").astype(np.int64) for c in ("starts", "rows", "counts"))
        pick, known = np.arange(len(terms)), len(terms)
        for place, lemma in changed:
            pick[place.to_numpy()] = known + np.arange(len(place))
            known += len(place)
        terms = pa.concat_arrays([terms, *(lemma for _, lemma in changed)]).take(pa.array(pick))
        # a lemma of several words is as many terms, an empty one is none
        split = pc.split_pattern(terms, " ")
        of, flat = np.repeat(np.arange(len(terms)), pc.list_value_length(split).to_numpy()), split.flatten()
        kept = pc.not_equal(flat, "")
        of, coded = of[kept.to_numpy(zero_copy_only=False)], flat.filter(kept).dictionary_encode()
        size = np.diff(starts)[of]
        posting = np.repeat(starts[of] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        key, place = np.unique(np.repeat(coded.indices.to_numpy().astype(np.int64), size) * n + rows[posting], return_inverse=True)
        term, tf = key // max(1, n), np.bincount(place, counts[posting], key.size)
        binary = [np.asarray(x, "<i4").tobytes() for x in (np.searchsorted(term, np.arange(len(coded.dictionary) + 1)), key % max(1, n), tf)]
        return pa.RecordBatch.from_arrays(
            [batch.column("block")[at:at + 1], pa.array([n], pa.int32()), batch.column("key1")[at:at + 1], batch.column("key2")[at:at + 1],
             pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), *(pa.array([x], pa.binary()) for x in binary)],
            ["block", "n", "key1", "key2", "terms", "starts", "rows", "counts"])

    def run(batches):
        waiting = []
        for batch in batches:
            first = 0
            for at in [*np.flatnonzero(batch.column("n").is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]:
                if first < at:
                    waiting.append((batch.column("i")[first:at], batch.column("lemma")[first:at]))
                if at < batch.num_rows:
                    yield lemmatised(batch, at, waiting)
                    waiting, first = [], at + 1
                    release()

    bound_batches(blocks.sparkSession)
    forms = blocks.select("block", F.posexplode("terms").alias("i", "form"))
    lemmas = memo.filter("form is not null and lemma is not null").groupBy("form").agg(F.min("lemma").alias("lemma"))
    changed = forms.join(lemmas, "form").filter("lemma <> form").select("block", "i", "lemma")
    # a block comes behind its changed terms
    both = changed.unionByName(blocks.withColumn("i", F.lit(None).cast("int")), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", F.col("i").asc_nulls_last()).mapInArrow(run, SCHEMA)


# --- scoring -------------------------------------------------------------------

def _slices(times, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``times`` whose sums are at most ``most``, or of one entry."""
    import numpy as np

    last, a = np.cumsum(times), 0
    while a < last.size:
        z = max(a + 1, int(np.searchsorted(last, (last[a - 1] if a else 0) + most, "right")))
        yield a, z
        a = z


class _Block:
    """A decoded block: postings (row, weight) of every term, and the largest weight of each."""

    def __init__(self, r: dict):
        import numpy as np

        self.n, self.terms = r["n"], r["terms"]
        self.key1, self.key2 = np.frombuffer(r["key1"], "<i8"), np.frombuffer(r["key2"], "<i8")
        self.starts = np.frombuffer(r["starts"], "<i4").astype(np.int64)
        self.row = np.frombuffer(r["rows"], "<i4").astype(np.int64)
        counts = np.frombuffer(r["counts"], "<i4").astype(np.float64)
        norm = np.sqrt(np.bincount(self.row, counts * counts, self.n))
        self.weight = counts / norm[self.row]
        self.size = np.diff(self.starts)
        self.top = np.maximum.reduceat(self.weight, self.starts[:-1]) if self.row.size else np.zeros(0)

    def place_of(self, other: "_Block"):
        """The place of every term of ``other`` among those of this block, -1 for unknown ones; the terms of blocks that were ``joined`` are looked up once."""
        import pyarrow.compute as pc

        terms, at = getattr(other, "_joined", (other.vocabulary(), slice(None)))
        if getattr(self, "_looked_up", (None,))[0] is not terms:
            found = pc.fill_null(pc.index_in(terms, value_set=self.vocabulary()), -1).to_numpy(zero_copy_only=False)
            self._looked_up = terms, found.astype("i8")
        return self._looked_up[1][at]

    @staticmethod
    def joined(blocks: list["_Block"]) -> None:
        """The blocks get their places among the distinct terms of all of them."""
        import pyarrow as pa
        import pyarrow.compute as pc

        terms = pc.unique(pa.chunked_array([b.vocabulary() for b in blocks]))
        for b in blocks:
            b._joined = terms, pc.index_in(b.vocabulary(), value_set=terms).to_numpy().astype("i8")

    def vocabulary(self):
        import pyarrow as pa

        if not hasattr(self, "_vocabulary"):
            self._vocabulary = self.terms if isinstance(self.terms, pa.Array) else pa.array(self.terms, pa.string())
        return self._vocabulary

    def arranged(self, most: int):
        """Groups of alike rows: (order, edges); group ``g`` holds the rows ``order[edges[g]:edges[g + 1]]``, ``most`` at most."""
        import numpy as np

        if not hasattr(self, "_arranged"):
            marks = np.argsort(-self.size, kind="stable")[:MARKS]
            m = self.dense(marks).astype(np.float32)
            length = np.sqrt((m * m).sum(1))
            m /= np.where(length > 0, length, 1)[:, None]
            # the first centres lie far apart (a row without a mark is near to none), then every row goes to its nearest one
            centres = [m[int(length.argmax())]] if self.n else []
            near = np.where(length > 0, m @ centres[0], 1) if self.n else np.ones(1)
            while len(centres) < GROUPS and near.min() < 1 - 1e-6:
                centres.append(m[int(near.argmin())])
                near = np.maximum(near, m @ centres[-1])
            group = np.zeros(self.n, np.int64)
            for _ in range(ROUNDS if self.n else 0):
                c = np.stack(centres)
                group = (m @ c.T).argmax(1)
                sums = np.zeros_like(c)
                np.add.at(sums, group, m)
                size = np.sqrt((sums * sums).sum(1))
                centres = [x / y if y > 0 else z for x, y, z in zip(sums, size, c)]
            c = np.stack(centres) if centres else np.zeros((1, 1))
            group = ((c @ c.T) > ALIKE).argmax(1)[group] if self.n else group  # centres that are near to each other are one
            size = np.bincount(group, minlength=GROUPS)
            group[size[group] * SMALL < self.n] = GROUPS  # the rows of small groups make one
            order = np.argsort(group, kind="stable")
            size = np.bincount(group, minlength=GROUPS + 1)
            step = -(-size // np.maximum(1, -(-size // most)))  # groups of more than ``most`` rows are cut evenly
            at = (np.arange(self.n) - np.searchsorted(group[order], group[order])) % np.maximum(1, step)[group[order]]
            edges = np.append(np.flatnonzero(at == 0), self.n)
            self._arranged = order, edges
        return self._arranged

    def by_group(self, most: int):
        """(largest weight, number of rows, first posting) of every group and term, and the postings group by group: (place in the group, weight)."""
        import numpy as np

        if not hasattr(self, "_by_group"):
            order, edges = self.arranged(most)
            n, terms = max(1, edges.size - 1), self.size.size
            group, place = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
            group[order] = np.repeat(np.arange(edges.size - 1), np.diff(edges))
            place[order] = np.arange(self.n) - edges[group[order]]
            cell = group[self.row] * terms + np.repeat(np.arange(terms), self.size)
            by = np.argsort(cell, kind="stable")
            often = np.bincount(cell, minlength=n * terms)
            first = np.cumsum(often) - often
            top = np.zeros(n * terms)
            if by.size:
                top[often > 0] = np.maximum.reduceat(self.weight[by], first[often > 0])
            self._by_group = (*(x.reshape(n, terms) for x in (top, often, first)), place[self.row[by]], self.weight[by].astype(np.float32))
        return self._by_group

    def by_rank(self, most: int):
        """(starts, terms, weights): the postings row by row, in the order of ``arranged``."""
        import numpy as np

        if not hasattr(self, "_by_rank"):
            starts, terms, weights = self.by_row()
            order, _ = self.arranged(most)
            size = np.diff(starts)[order]
            ends = np.cumsum(size)
            at = np.repeat(starts[order] - (ends - size), size) + np.arange(terms.size)
            self._by_rank = np.append(0, ends), terms[at], weights[at]
        return self._by_rank

    def by_row(self):
        """(starts, terms, weights): the postings row by row."""
        import numpy as np

        if not hasattr(self, "_by_row"):
            order = np.argsort(self.row, kind="stable")
            term = np.repeat(np.arange(self.size.size), self.size)
            self._by_row = np.append(0, np.cumsum(np.bincount(self.row, minlength=self.n))), term[order], self.weight[order]
        return self._by_row

    def weights_of(self, terms, rows):
        """The weights of (term, row) pairs, 0.0 where the row lacks the term or the term is -1."""
        import numpy as np

        if not hasattr(self, "_keys"):
            self._keys = np.repeat(np.arange(self.size.size), self.size) * self.n + self.row  # ascending
        key = terms * self.n + rows
        at = np.searchsorted(self._keys, key)
        at[at == self._keys.size] = 0
        return np.where((terms >= 0) & (self._keys[at] == key), self.weight[at], 0.0)

    def dense(self, terms):
        """Columns of the given terms as a matrix."""
        import numpy as np

        out = np.zeros((self.n, terms.size))
        at, col = self.postings(terms)
        out[self.row[at], col] = self.weight[at]
        return out

    def postings(self, terms):
        """(posting, position in ``terms``) of all postings of the given terms."""
        import numpy as np

        size = self.size[terms]
        col = np.repeat(np.arange(terms.size), size)
        return np.repeat(self.starts[terms] - (np.cumsum(size) - size), size) + np.arange(col.size), col


class _Best:
    """Candidates for the ``k`` best of every question of a block: a later row under its floor can't be one."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.k, self.unit = k, 10 ** SCORE_DIGITS
        self.floor = np.zeros(n)  # k-th best score so far, less what rounding may hide
        self.q, self.key1, self.key2, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, questions, scores, key1, key2):
        import numpy as np

        n = scores.shape[1]
        floor = self.floor[questions]
        if n > self.k:
            floor = np.maximum(floor, np.partition(scores, n - self.k, axis=1)[:, n - self.k] - 2 / self.unit)
        i, j = np.nonzero((scores > 0) & (scores >= floor[:, None]))
        self.put(questions[i], scores[i, j], key1[j], key2[j])

    def put(self, questions, scores, key1, key2):
        """Single pairs of a question and a row with their score above 0."""
        import numpy as np

        if not questions.size:
            return
        q, a, b, s = (np.concatenate(x) for x in ((self.q, questions), (self.key1, key1), (self.key2, key2), (self.score, scores)))
        rounded = np.rint(s * self.unit)
        order = np.lexsort((b, a, -rounded, q))
        q, a, b, s, rounded = q[order], a[order], b[order], s[order], rounded[order]
        place = np.arange(q.size) - np.searchsorted(q, q)
        kth = place == self.k - 1
        self.floor[q[kth]] = np.maximum(self.floor[q[kth]], (rounded[kth] - 1.5) / self.unit)
        # rows that rounding in the last digit might still lift: of one rounded score the k smallest keys are enough
        fresh = np.append(True, (q[1:] != q[:-1]) | (rounded[1:] != rounded[:-1]))
        among = np.arange(q.size) - np.maximum.accumulate(np.where(fresh, np.arange(q.size), 0))
        keep = (s >= self.floor[q]) & (among < self.k)
        self.q, self.key1, self.key2, self.score = q[keep], a[keep], b[keep], s[keep]


def block_scores(asked: _Block, held: _Block, floor=None, rare: int = 64, stride: int = 1024, most: int = PAIRS) -> Iterator[tuple]:
    """(questions, scores, key1, key2) for strides of the rows of ``held``; ``floor``: scores that a question must be able to reach."""
    import numpy as np

    in_q = asked.place_of(held)
    c_term = np.flatnonzero(in_q >= 0)
    q_term = in_q[c_term]
    if not c_term.size:
        return
    at, col = asked.postings(q_term)
    bound = np.bincount(asked.row[at], asked.weight[at] * held.top[c_term[col]], asked.n)
    active = np.flatnonzero((bound > 0) & (bound * (1 + 1e-9) >= floor)) if floor is not None else np.flatnonzero(bound > 0)
    if not active.size:
        return
    often = held.size[c_term] * rare > held.n
    q_heavy, c_heavy = asked.dense(q_term[often])[active], held.dense(c_term[often])
    # postings of rare terms: the questions' side in active numbers, the corpus side cut into strides
    number = np.full(asked.n, -1)
    number[active] = np.arange(active.size)
    at, col = asked.postings(q_term[~often])
    live = number[asked.row[at]] >= 0
    at, col = at[live], col[live]
    q_row, q_weight = number[asked.row[at]], asked.weight[at]
    per_term = np.bincount(col, minlength=int((~often).sum()))
    first = np.cumsum(per_term) - per_term
    c_at, c_col = held.postings(c_term[~often])
    wanted = per_term[c_col] > 0
    c_at, c_col = c_at[wanted], c_col[wanted]
    order = np.argsort(held.row[c_at] // stride, kind="stable")
    c_at, c_col = c_at[order], c_col[order]
    c_row, c_weight = held.row[c_at], held.weight[c_at]
    edges = np.searchsorted(c_row // stride, np.arange(-(-held.n // stride) + 1))
    for s, a in enumerate(range(0, held.n, stride)):
        wide = min(stride, held.n - a)
        scores = q_heavy @ c_heavy[a:a + wide].T
        part = slice(edges[s], edges[s + 1])
        for b, z in _slices(per_term[c_col[part]], max(most, scores.size)):  # no fewer than the scores that each slice adds to
            mine = slice(edges[s] + b, edges[s] + z)
            times = per_term[c_col[mine]]
            ends = np.cumsum(times)
            who = np.repeat(first[c_col[mine]] - (ends - times), times) + np.arange(ends[-1])
            flat = q_row[who] * wide + np.repeat(c_row[mine] - a, times)
            scores += np.bincount(flat, q_weight[who] * np.repeat(c_weight[mine], times), scores.size).reshape(scores.shape)
        yield active, scores, held.key1[a:a + wide], held.key2[a:a + wide]


class _Cell:
    """A group of questions against a group of rows: how each shared term is scored, in single precision.

    A term that many questions and rows share goes through the matrix product, one
    that many rows have is spelled out as a line over the rows, which the questions
    that have it add up; of the others the postings are paired.
    """

    def __init__(self, who, term, weight, n: int, n_c, first, wide: int, rare: int, most: int):
        """Postings of ``n`` questions (who, term, weight); of every term the number of rows ``n_c`` and its first posting."""
        import numpy as np

        n_q = np.bincount(term, minlength=n_c.size)
        lined = (n_c * LINED > wide) & (n_q > 0)
        heavy = (n_q * n_c * rare > n * wide) & (~lined | (n_q * SHARED > n))
        lined &= ~heavy
        if np.count_nonzero(lined) * wide > most:  # no more lines than fit
            lined[np.argsort(-np.where(lined, n_c, 0), kind="stable")[most // wide:]] = False
        self.terms = np.concatenate([np.flatnonzero(heavy), np.flatnonzero(lined)])
        self.heavy, line = np.count_nonzero(heavy), np.zeros(n_c.size, np.int64)
        line[self.terms] = np.arange(self.terms.size)
        # questions by their number of lines, so that those of a strip have equally many
        mine = lined[term]
        lines = np.bincount(who[mine], minlength=n)
        self.order = np.argsort(lines, kind="stable")
        self.lines = lines[self.order]
        number = np.empty(n, np.int64)
        number[self.order] = np.arange(n)
        who = number[who]
        self.asking = np.zeros((n, self.heavy), np.float32)
        some = heavy[term]
        self.asking[who[some], line[term[some]]] = weight[some]
        by = np.argsort(who, kind="stable")
        who, term, weight, some, mine = who[by], term[by], weight[by], some[by], mine[by]
        self.line, self.line_weight = line[term[mine]], weight[mine]
        rest = ~some & ~mine
        self.who, self.weight, self.times, self.first = who[rest], weight[rest], n_c[term[rest]], first[term[rest]]
        self.rest_at, self.line_at = (np.append(0, np.cumsum(x)) for x in (np.bincount(self.who, minlength=n), self.lines))

    def runs(self, a: int, z: int, wide: int) -> Iterator[tuple[int, int, int]]:
        """(first, last, lines): the questions from ``a`` to ``z`` in ranges of equally many lines, of ``STRIP`` spelled out weights or of one question."""
        import numpy as np

        mine = self.lines[a:z]
        cuts = [0, *(np.flatnonzero(mine[1:] != mine[:-1]) + 1).tolist(), z - a]
        for x, y in zip(cuts[:-1], cuts[1:]):
            if m := int(mine[x]):
                step = max(1, STRIP // (m * wide))
                for i in range(x, y, step):
                    yield a + i, a + min(y, i + step), m

    def scores(self, spot, weight, n_c, first, wide: int, most: int) -> Iterator[tuple]:
        """(questions, scores) strip by strip; a strip's scores go when the next ones come.

        ``spot`` and ``weight``: the postings of the rows, of which each of ``self.terms`` has ``n_c`` from ``first`` on.
        """
        import numpy as np

        body = np.zeros((self.terms.size, wide), np.float32)
        at = np.repeat(first - (np.cumsum(n_c) - n_c), n_c) + np.arange(int(n_c.sum()))
        body[np.repeat(np.arange(n_c.size), n_c), spot[at]] = weight[at]
        n, step = self.lines.size, max(1, STRIP // wide)
        # what is written again and again stays in one place
        one, two = (np.empty((min(n, step), wide), np.float32) for _ in range(2))
        three, count = np.empty(max(STRIP, int(self.lines.max()) * wide), np.float32), np.arange(SPREAD + wide)
        for a in range(0, n, step):
            z = min(n, a + step)
            scores = np.matmul(self.asking[a:z], body[:self.heavy], out=one[:z - a])
            for x, y, m in self.runs(a, z, wide):
                part = slice(self.line_at[x], self.line_at[y])
                lines = np.take(body, self.line[part], axis=0, out=three[:(y - x) * m * wide].reshape(-1, wide), mode="clip")
                scores[x - a:y - a] += np.matmul(self.line_weight[part].reshape(-1, 1, m), lines.reshape(-1, m, wide), out=two[:y - x, None])[:, 0]
            part = slice(self.rest_at[a], self.rest_at[z])
            who, mine, times, begin = (self.who[part] - a) * wide, self.weight[part], self.times[part], self.first[part]
            flat = scores.reshape(-1)
            for b, e in _slices(times, min(most, SPREAD)):
                t = times[b:e]
                ends = np.cumsum(t)
                pair = np.repeat(begin[b:e] - (ends - t), t)
                pair += count[:pair.size]
                at = np.repeat(who[b:e], t)
                at += spot[pair]
                w = np.repeat(mine[b:e], t)
                w *= weight[pair]
                np.add.at(flat, at, w)
            yield slice(a, z), scores


def best_of_block(asked: _Block, held: _Block, best: _Best, rare: int = RARE, stride: int = STRIDE, most: int = PAIRS) -> None:
    """Puts all rows of ``held`` that can be among the best of a question of ``asked`` into ``best``."""
    import numpy as np

    in_c = held.place_of(asked)
    some = np.zeros(held.size.size, bool)
    some[in_c[in_c >= 0]] = True
    shared = np.flatnonzero(some)
    if not shared.size:
        return
    top, often, first, spot, weight = held.by_group(stride)
    order, edges = held.arranged(stride)
    q_order, q_edges = asked.arranged(stride)
    starts, terms, weights = asked.by_rank(stride)
    # postings of the questions by their place in the order, terms by their place among the shared ones
    q_term = (np.cumsum(some) - 1)[in_c][terms]
    known = in_c[terms] >= 0
    q_row, q_term, q_weight = np.repeat(np.arange(asked.n), np.diff(starts))[known], q_term[known], weights[known]
    single = q_weight.astype(np.float32)
    q_at = np.searchsorted(q_row, q_edges)
    # single precision: every product and every sum is off by 2 ** -24 of itself at most
    slack = (int(np.diff(starts).max()) + 4) * 2.0 ** -23
    least = 2 * slack + 2 / best.unit  # a row whose score is so far under the k-th best one in single precision is none of the k best
    low = np.maximum(best.floor[q_order] - slack, TINY).astype(np.float32)
    found, waiting = [], 0  # (questions, rows, scores) not under ``low``

    def exact(i, j):
        size = starts[i + 1] - starts[i]
        pair = np.repeat(np.arange(i.size), size)
        posting = np.repeat(starts[i] - (np.cumsum(size) - size), size) + np.arange(pair.size)
        score = np.bincount(pair, weights[posting] * held.weights_of(in_c[terms[posting]], j[pair]), i.size)
        i = q_order[i]
        keep = score >= best.floor[i]
        return i[keep], score[keep], held.key1[j[keep]], held.key2[j[keep]]

    def settle():
        """What can still be among the best is scored again in double precision; rows of equal texts can make any number of it."""
        i, j, s = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((-s, i))
        i, j, s = i[by], j[by], s[by]
        kth = np.arange(i.size) - np.searchsorted(i, i) == best.k - 1
        low[i[kth]] = np.maximum(low[i[kth]], s[kth] - least)
        keep = s >= low[i]
        i, j = i[keep], j[keep]
        for b, e in _slices(starts[i + 1] - starts[i], most):
            best.put(*exact(i[b:e], j[b:e]))
        low[:] = np.maximum(low, best.floor[q_order] - slack)

    for g in range(edges.size - 1):
        rows = order[edges[g]:edges[g + 1]]
        wide, n_c, begin = rows.size, often[g, shared], first[g, shared]
        bound = np.bincount(q_row, q_weight * top[g, shared][q_term], asked.n)
        active = (bound > 0) & (bound * (1 + 1e-9) >= low)
        for c in range(q_edges.size - 1):
            live = active[q_edges[c]:q_edges[c + 1]]
            if not live.any():
                continue
            part = slice(q_at[c], q_at[c + 1])
            who, term, mine = q_row[part] - q_edges[c], q_term[part], single[part]
            some = live[who] & (n_c[term] > 0)
            n = int(np.count_nonzero(live))
            cell = _Cell((np.cumsum(live) - 1)[who[some]], term[some], mine[some], n, n_c, begin, wide, rare, most)
            asking = q_edges[c] + np.flatnonzero(live)[cell.order]
            for strip, scores in cell.scores(spot, weight, n_c[cell.terms], begin[cell.terms], wide, most):
                who = asking[strip]
                good = np.flatnonzero(scores.max(1) >= low[who])
                if not good.size:
                    continue
                who, scores = who[good], scores[good]
                hit = scores >= low[who][:, None]
                many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 2 * best.k)
                if many.size and wide > best.k:
                    kth = np.partition(scores[many], wide - best.k, axis=1)[:, wide - best.k]
                    low[who[many]] = np.maximum(low[who[many]], kth - least)
                    hit[many] = scores[many] >= low[who[many]][:, None]
                i, j = np.nonzero(hit)
                found.append((who[i], rows[j], scores[i, j]))
                waiting += i.size
                if waiting > most:
                    settle()
                    found, waiting = [], 0
    if found:
        settle()


def _batches(asked: DataFrame, most: int = BATCH_BYTES) -> list[list[int]]:
    """Numbers of question blocks whose sizes sum to at most ``most`` bytes (one row a block reaches the driver)."""
    size = F.octet_length("rows") + F.octet_length("counts") + F.octet_length(F.concat_ws(" ", "terms"))
    groups, held = [], 0
    for block, n in asked.select("block", size.alias("n")).orderBy("block").collect():
        if not groups or held + n > most:
            groups.append([])
            held = 0
        groups[-1].append(block)
        held += n
    return groups


def passes(asked: DataFrame, most: int | None = None) -> int:
    """How often the corpus is read for the written blocks of ``asked``."""
    return len(_batches(asked, most or BATCH_BYTES))


def _meet(asked: DataFrame, held: DataFrame, most: int) -> DataFrame | None:
    """Every block of ``held`` beside the written blocks of ``asked``, in passes over ``held``; None without questions."""
    bound_batches(held.sparkSession)
    passes = None
    names = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
    zero = F.col("n") * 0  # what both sides are joined on
    for numbers in _batches(asked, most):
        # the questions as one array in one row: a corpus block travels once, whatever their number
        some = asked.filter(F.col("block").isin(numbers)).agg(F.collect_list(F.struct(*names)).alias("asked"), F.max(zero).alias("zero"))
        got = held.withColumn("zero", zero).join(F.broadcast(some), "zero")  # at most ``most`` bytes
        passes = got if passes is None else passes.unionByName(got)
    return passes


def _pairs_of_blocks(batches):
    """(question block, corpus block) of the joined rows; a question block is decoded once a task."""
    import pyarrow as pa

    cache: dict[int, _Block] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            held = _Block({c: batch.column(c)[i].as_py() for c in ("n", "key1", "key2", "starts", "rows", "counts")} | {"terms": batch.column("terms")[i].values})
            asked = batch.column("asked")[i].values
            numbers = asked.field("block").to_pylist()
            if any(number not in cache for number in numbers):
                for j, number in enumerate(numbers):
                    r = asked[j].as_py()
                    cache[number] = _Block(r | {"terms": pa.array(r["terms"], pa.string())})
                _Block.joined([cache[number] for number in numbers])
            for number in numbers:
                yield number, cache[number], held
            held = asked = None
            release()


def block_top_k(asked: DataFrame, held: DataFrame, k: int = TOP_K, q_id: str = "qid", c_ids: tuple[str, str] = ("doc_id", "pos"),
                most: int = BATCH_BYTES, rare: int = RARE, stride: int = STRIDE) -> DataFrame:
    """F4 + F5: (qid, doc_id, pos, score, rank), the ``k`` best corpus rows of every question; ``asked`` is written, ``held`` may be lazy."""
    import numpy as np
    import pyarrow as pa

    spark = held.sparkSession
    names = [q_id, *c_ids, "score"]
    kinds = dict(zip(names, ("long", "long", "int", "double")))

    def run(batches):
        best = {}
        for number, block, corpus in _pairs_of_blocks(batches):
            if number not in best:
                best[number] = block.key1, _Best(block.n, k)
            best_of_block(block, corpus, best[number][1], rare, stride)
        for keys, mine in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(keys[mine.q]), pa.array(mine.key1), pa.array(mine.key2.astype(np.int32)),
                                              pa.array(mine.score)], names)

    schema = ", ".join(f"{n} {t}" for n, t in kinds.items())
    met = _meet(asked, held, most)
    found = met.mapInArrow(run, schema) if met is not None else spark.createDataFrame([], schema)
    return rank_top_k(found, [q_id], list(c_ids), k)


def block_pairs(asked: DataFrame, held: DataFrame, q_id: str = "qid", c_ids: tuple[str, str] = ("doc_id", "pos"), most: int = BATCH_BYTES) -> DataFrame:
    """F4 alone: the score of every pair that shares a term."""
    import numpy as np
    import pyarrow as pa

    names = [q_id, *c_ids, "score"]

    def run(batches):
        for _, block, corpus in _pairs_of_blocks(batches):
            for who, scores, key1, key2 in block_scores(block, corpus):
                for a, z in _slices(np.count_nonzero(scores > 0, axis=1), PAIRS):
                    i, j = np.nonzero(scores[a:z] > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(block.key1[who[a + i]]), pa.array(key1[j]), pa.array(key2[j].astype(np.int32)),
                                                      pa.array(scores[a + i, j])], names)

    schema = f"{q_id} long, {c_ids[0]} long, {c_ids[1]} int, score double"
    met = _meet(asked, held, most)
    return met.mapInArrow(run, schema) if met is not None else held.sparkSession.createDataFrame([], schema)
