"""Block scoring, lemmas, dense retrieval and the chunk store against plain Python."""
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import term_blocks as TB
from lectern.session import written

WORDS = ["the", "a", "of", "и", "naïve"] + [f"w{i}" for i in range(300)]


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        common = r.choices(WORDS[:5], k=r.randrange(0, 6))
        rare = r.choices(WORDS[5:], k=r.randrange(0, 12))
        out.append((i % 97 - 5, i // 97, " ".join(common + rare) if i % 50 else ("", None, "...", "the " * 400)[i // 50 % 4]))
    return out


def vector(text):
    n = Counter((text or "").replace(".", " ").split())
    norm = math.sqrt(sum(v * v for v in n.values()))
    return {t: v / norm for t, v in n.items()}


def brute(questions, corpus, k):
    out = set()
    held = [((a, b), vector(t)) for a, b, t in corpus]
    for q, t in questions:
        v = vector(t)
        scored = [(round(s, 9), key) for key, c in held if (s := sum(w * c.get(x, 0) for x, w in v.items())) > 0]
        for rank, (s, (a, b)) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1):
            out.add((q, a, b, rank, round(s, 6)))
    return out


@pytest.fixture(scope="module")
def sides(spark):
    corpus = texts(1, 900)
    questions = [(1000 + i, t) for i, (_, _, t) in enumerate(texts(2, 120))] + [(-7, "unheard words only"), (5, None)]
    c = spark.createDataFrame(corpus, "doc_id long, pos int, text string").repartition(5)
    return corpus, questions, c, spark.createDataFrame(questions, "qid long, question string")


def top_rows(df):
    return {(r.qid, r.doc_id, r.pos, r.rank, round(r.score, 6)) for r in df.collect()}


@pytest.mark.parametrize("rows,most,rare", [(4096, 16 << 20, 64), (37, 2000, 2), (200, 16 << 20, 10**9), (1, 16 << 20, 1)])
def test_block_top_k(spark, sides, rows, most, rare):
    """Whatever the blocks, batches and the line between frequent and rare terms, the result is that of all pairs."""
    corpus, questions, c, q = sides
    asked = written(TB.term_blocks(q, "qid", None, "question", rows=50, size=1500), "asked")
    got = top_rows(TB.block_top_k(asked, TB.term_blocks(c, "doc_id", "pos", "text", rows=rows), 3, most=most, rare=rare,
                                  stride=64 if rows == 200 else 1024))
    assert got == brute(questions, corpus, 3)
    if most == 2000:
        assert len(TB._batches(asked, most)) > 1


def plain_block(texts_of_rows, first_key=0):
    """A decoded block of token lists, without Spark."""
    terms = sorted({t for ts in texts_of_rows for t in ts})
    found = [[(i, ts.count(t)) for i, ts in enumerate(texts_of_rows) if t in ts] for t in terms]
    keys = np.arange(first_key, first_key + len(texts_of_rows), dtype="<i8")
    flat = np.array([x for f in found for x in f], "<i4").reshape(-1, 2)
    return TB._Block({"n": len(texts_of_rows), "terms": terms, "key1": keys.tobytes(), "key2": np.zeros_like(keys).tobytes(),
                      "starts": np.append(0, np.cumsum([len(f) for f in found])).astype("<i4").tobytes(),
                      "rows": flat[:, 0].tobytes(), "counts": flat[:, 1].tobytes()})


@pytest.mark.parametrize("rare", [64, 10**9])
def test_scoring_copies_stays_small(rare):
    """Equal texts are hits by the hundred of every question, and their postings pairs by the million: neither is spelled out at once."""
    import tracemalloc

    text = [f"t{i}" for i in range(100)]
    asked, held = plain_block([text] * 100), plain_block([text] * 512 + [["t0", "u"]] * 3, 1000)
    best = TB._Best(asked.n, 3)
    tracemalloc.start()
    TB.best_of_block(asked, held, best, rare=rare, most=1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20, peak  # all at once take over 100 MB
    for q in range(asked.n):
        mine = best.q == q
        assert sorted(zip(best.key1[mine].tolist(), best.score[mine].round(9).tolist())) == [(1000, 1.0), (1001, 1.0), (1002, 1.0)]


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_slices_of_pairs(sides, most):
    """Whatever is spelled out at once, the best rows are those of all pairs."""
    tokens = [[(t or "").replace(".", " ").split() for *_, t in side] for side in (sides[1][:40], sides[0][:200])]
    asked, held = (plain_block(ts) for ts in tokens)
    found = []
    for step in (most, 1 << 30):
        best = TB._Best(asked.n, 3)
        TB.best_of_block(asked, held, best, rare=4, stride=64, most=step)
        order = np.lexsort((best.key1, -best.score.round(9), best.q))
        at = np.arange(order.size) - np.searchsorted(best.q[order], best.q[order])
        found.append([(int(best.q[i]), int(best.key1[i]), round(float(best.score[i]), 9)) for i in order[at < 3]])
        rows = {(int(q), j): s for q, scores, k1, _ in TB.block_scores(asked, held, rare=4, stride=64, most=step)
                for q, line in zip(q, scores) for j, s in zip(k1.tolist(), line.round(9).tolist()) if s > 0}
        found.append(rows)
    assert found[0] == found[2] and found[1] == found[3] and found[0]


def test_blocks_across_batches(spark, sides, monkeypatch):
    """Blocks are cut from Arrow batches of any size, and hold every text once."""
    monkeypatch.setattr(TB, "bound_batches", lambda s: None)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "10")
    try:
        blocks = TB.term_blocks(sides[2].coalesce(1), "doc_id", "pos", "text", rows=37).collect()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    assert [b.n for b in blocks] == [37] * (900 // 37) + [900 % 37]
    got = Counter(k for b in blocks for k in zip(np.frombuffer(b.key1, "<i8").tolist(), np.frombuffer(b.key2, "<i8").tolist()))
    assert got == Counter((a, b) for a, b, _ in sides[0])


def test_workers_give_memory_back(monkeypatch):
    """A worker frees what the blocks of a batch took before it asks for the next one."""
    import pyarrow as pa

    freed, read = [], []
    monkeypatch.setattr(TB, "release", lambda: freed.append(len(read)))

    def batches():
        for n in range(3):
            read.append(n)
            raw = {"n": 1, "key1": b"\0" * 8, "key2": b"\0" * 8, "terms": ["a"], "starts": np.array([0, 1], "<i4").tobytes(),
                   "rows": b"\0" * 4, "counts": b"\1\0\0\0"}
            yield pa.RecordBatch.from_pylist([{**raw, "asked": [{**raw, "block": 0}]}])

    assert len(list(TB._pairs_of_blocks(batches()))) == 3 and freed == [1, 2, 3]


def test_block_pairs(spark, sides):
    corpus, questions, c, q = sides
    got = {(r.qid, r.doc_id, r.pos): r.score for r in TB.block_pairs(written(TB.question_blocks(q), "asked"), TB.term_blocks(c, "doc_id", "pos", "text")).collect()}
    want = {(i, a, b): s for i, t in questions for a, b, x in corpus if (s := sum(w * vector(x).get(k, 0) for k, w in vector(t).items())) > 0}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in got)


def test_block_top_k_without_rows(spark, sides):
    _, _, c, q = sides
    held, asked = TB.term_blocks(c, "doc_id", "pos", "text"), written(TB.question_blocks(q), "asked")
    assert TB.block_top_k(written(TB.question_blocks(q.limit(0)), "none"), held).count() == 0
    assert TB.block_top_k(asked, TB.term_blocks(c.limit(0), "doc_id", "pos", "text")).count() == 0


def test_blocks_are_skipped(spark):
    """A block whose bound is under a question's k-th best score gives no scores."""
    def block(rows):
        terms = sorted({t for r in rows for t in r})
        posts = [[(i, r[t]) for i, r in enumerate(rows) if t in r] for t in terms]
        flat = [x for p in posts for x in p]
        return TB._Block({"n": len(rows), "terms": terms, "key1": np.arange(len(rows), dtype="<i8").tobytes(), "key2": np.zeros(len(rows), "<i8").tobytes(),
                          "starts": np.cumsum([0] + [len(p) for p in posts]).astype("<i4").tobytes(),
                          "rows": np.array([x[0] for x in flat], "<i4").tobytes(), "counts": np.array([x[1] for x in flat], "<i4").tobytes()})

    asked, held = block([{"a": 1}, {"b": 1}]), block([{"a": 1, "b": 3, "c": 1}])
    scored = list(TB.block_scores(asked, held, np.array([0.5, 0.5])))
    assert scored[0][0].tolist() == [1]  # the first question reaches 0.30 at most
    assert not list(TB.block_scores(asked, held, np.array([0.5, 0.95])))


# --- lemmas ----------------------------------------------------------------------

def test_memo_learns_each_form_once(spark, tmp_path):
    from lectern.operators.lemmas import Lemmas

    def make():
        import os

        def lemmatise(forms):
            with open(f"{tmp_path}/calls-{os.getpid()}", "a") as f:
                f.writelines(x + "\n" for x in forms)
            return [{"wolves": "wolf", "mice": "mouse", "gone": "", "pair": "two words"}.get(x) for x in forms]

        return lemmatise

    lemmas = Lemmas(f"{tmp_path}/memo", make)
    c = spark.createDataFrame([(1, 0, "Wolves, mice; wolf"), (1, 1, "mice mouse gone"), (2, 0, None), (3, 0, "gone"), (4, 0, "pair WOLVES")],
                              "doc_id long, pos int, text string").repartition(3)
    held = written(lemmas.of_blocks(TB.term_blocks(c, "doc_id", "pos", "text", rows=2)), "held")
    got = {}
    for r in held.collect():
        b = TB._Block(r.asDict())
        for i, t in enumerate(b.terms):
            for at in range(b.starts[i], b.starts[i + 1]):
                got[b.key1[b.row[at]], b.key2[b.row[at]], t] = round(b.weight[at], 9)
    one, two = round(2 / 5 ** 0.5, 9), round(1 / 5 ** 0.5, 9)
    third = round(1 / 3 ** 0.5, 9)
    assert got == {(1, 0, "wolf"): one, (1, 0, "mouse"): two, (1, 1, "mouse"): 1.0, (4, 0, "two"): third, (4, 0, "words"): third, (4, 0, "wolf"): third}
    asked = lemmas.of_blocks(TB.question_blocks(spark.createDataFrame([(9, "wolf MICE unseen")], "qid long, question string")))
    top = TB.block_top_k(written(asked, "asked"), held, 5).collect()
    assert [(r.doc_id, r.pos) for r in top] == [(1, 0), (1, 1), (4, 0)]
    texts = {r.doc_id: r.norm for r in lemmas.of_texts(c.filter("pos = 0"), ["doc_id"], "text").collect()}
    assert texts == {1: "wolf mouse wolf", 2: "", 3: "", 4: "two words wolf"}
    calls = [x for f in tmp_path.glob("calls-*") for x in f.read_text().split("\n") if x]
    assert sorted(calls) == sorted(set(calls)) == ["gone", "mice", "mouse", "pair", "unseen", "wolf", "wolves"]


def test_answers_change_with_the_memo(spark):
    import __spark_entry__ as E

    plain, lemma = (E.queries()[k](spark, "/root/testdata/sf0.001").select("qid", "best_score").collect()
                    for k in ("answer_questions", "answer_questions_lemma"))
    assert sorted(plain) != sorted(lemma)


# --- chunk store -------------------------------------------------------------------

def scans(node):
    """File scans of an executed plan, through its finished stages."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from scans(node.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from scans(node.plan())
    elif name == "ReusedExchangeExec":
        return
    elif name == "FileSourceScanExec":
        yield node
    for i in range(node.children().size()):
        yield from scans(node.children().apply(i))


def test_chunk_store(spark, tmp_path):
    from lectern.sources.chunk_store import ChunkStore, write_chunk_store

    r = random.Random(4)
    rows = [(d, p, f"t{d}", f"text {d} {p} " + "x" * 200) for d in [*range(-20, 300), 2**40] for p in range(r.randrange(1, 9))]
    rows += [(500, p, "hot", "long document " * 20) for p in range(1500)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, pos int, title string, text string")
    write_chunk_store(df, f"{tmp_path}/store", parts=16)
    store = ChunkStore(spark, f"{tmp_path}/store")
    want = {i: x for i, x in enumerate(sorted(rows))}
    assert {x.chunk_id: (x.doc_id, x.pos, x.title, x.text) for x in store.numbered().collect()} == want
    keys = spark.createDataFrame([(1, 7, 0), (2, 500, 700), (2, 500, 700), (3, -99, 0), (4, 2**40, 0), (5, 7, 77), (6, None, 0)], "qid long, doc_id long, pos int")
    got = store.fetch(written(keys, "keys"))
    text = {x[:2]: x[2:] for x in rows}
    out = got.collect()
    assert sorted((x.qid, x.title, x.text) for x in out) == sorted((k.qid, *text.get((k.doc_id, k.pos), ("", ""))) for k in keys.collect())
    read = max(s.metrics().apply("numFiles").value() for s in scans(got._jdf.queryExecution().executedPlan()) if "part" in s.simpleString(999))
    assert read <= 5  # of 16: the ranges of the wanted keys
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    ids = written(spark.createDataFrame([(1, 5), (2, len(rows) - 1), (3, 10**9), (4, -1)], "qid long, chunk_id long"), "ids")
    got = {x.qid: (x.doc_id, x.pos, x.title, x.text) for x in store.fetch(ids, by="id").collect()}
    assert got == {1: want[5], 2: want[len(rows) - 1], 3: (None, None, "", ""), 4: (None, None, "", "")}


def test_empty_chunk_store(spark, tmp_path):
    from lectern.sources.chunk_store import ChunkStore, write_chunk_store

    write_chunk_store(spark.createDataFrame([], "doc_id long, pos int, title string, text string"), f"{tmp_path}/store")
    store = ChunkStore(spark, f"{tmp_path}/store")
    assert store.numbered().count() == 0
    assert store.fetch(spark.createDataFrame([(1, 7, 0)], "qid long, doc_id long, pos int")).select("text").first().text == ""


# --- what is scored --------------------------------------------------------------

def test_equal_questions_are_scored_once(spark, monkeypatch):
    """Equal texts make one row of a question block; every question, repeated ids too, gets its own ranks."""
    from lectern.plans import answer as AN

    docs = spark.createDataFrame([(i, "t", f"red ball number {i} in the green box") for i in range(6)], "doc_id long, title string, text string")
    scored = []
    real = AN.block_top_k

    def count(asked, *args):
        scored.append(asked.agg(F.sum("n")).first()[0])
        return real(asked, *args)

    monkeypatch.setattr(AN, "block_top_k", count)
    rows = [(1, "red ball"), (2, "red ball"), (2, "red ball"), (3, "number 4"), (4, None), (None, "red ball")]
    q = spark.createDataFrame(rows, "qid long, question string")
    got = sorted((r.qid, r.rank, r.doc_id) for r in AN.top_chunks(q, AN.build_corpus(docs), 2).collect())
    assert scored == [3]
    assert got == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 0), (3, 1, 4), (3, 2, 0)]


def test_chat_retrieves_where_the_code_model_failed(spark, monkeypatch):
    from lectern.operators.inference import Generators
    from lectern.plans import chat as CH

    def make(profile):
        return lambda prompts, seeds: ["" if "capital" in str(p).split("[USER]")[-1] else "print(1)" for p in prompts]

    asked = []
    real = CH.answer_questions

    def record(questions, *args):
        asked.extend(sorted(r.question for r in questions.collect()))
        return real(questions, *args)

    monkeypatch.setattr(CH, "answer_questions", record)
    turns = [(1, 0, "user", "the capital?"), (2, 0, "user", "the capital?"), (2, 1, "user", "write code"), (3, 0, "user", "2 + 2 capital")]
    conv = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r.reply for r in CH.chat_replies(conv, None, gens=Generators(code=make)).collect()}
    assert asked == ["2 + 2 capital", "the capital?"]
    assert got[2, 1] == "print(1)" and got[1, 0] == got[2, 0] == "Не знаю" and len(got) == 4


def test_groups_bound_and_score_alike_rows():
    """Grouped scoring finds what the pairs in double precision give, ties and near ties included."""
    r = np.random.default_rng(5)

    def block(n, words, first):
        rows, terms, counts = [], [], []
        for i in range(n):
            kind = r.integers(3) * words
            for t in np.unique(r.integers(0, words, r.integers(0, 12)) ** 2 // words + kind):
                rows.append(i), terms.append(t), counts.append(r.integers(1, 3))
        order = np.lexsort((rows, terms))
        rows, terms, counts = (np.array(x, np.int64)[order] for x in (rows, terms, counts))
        every, at = np.unique(terms, return_inverse=True)
        return TB._Block({"n": n, "terms": [f"t{x}" for x in every], "key1": (first + np.arange(n)).astype("<i8").tobytes(), "key2": np.zeros(n, "<i8").tobytes(),
                          "starts": np.searchsorted(at, np.arange(every.size + 1)).astype("<i4").tobytes(), "rows": rows.astype("<i4").tobytes(),
                          "counts": counts.astype("<i4").tobytes()})

    asked, found = block(150, 40, 0), []
    for how in ("pairs", "groups"):
        r, best = np.random.default_rng(6), TB._Best(150, 3)
        for first in (0, 1000, 2000, 3000):
            held = block(700, 40, first)
            if how == "pairs":
                for x in TB.block_scores(asked, held, best.floor):
                    best.add(*x)
            else:
                TB.best_of_block(asked, held, best, stride=100)
        order = np.lexsort((best.key1, -np.rint(best.score * 1e9), best.q))
        place = np.arange(order.size) - np.searchsorted(best.q[order], best.q[order])
        top = order[place < 3]
        found.append([(int(best.q[x]), int(best.key1[x]), round(float(best.score[x]), 9)) for x in top])
    assert found[0] == found[1] and len(found[0]) > 300


# --- tokens and partitions -------------------------------------------------------

def test_token_blocks_replace_forms_without_exploding_tokens(spark):
    from lectern.operators import token_blocks as TK

    rows = [(1, ["a", "bee", "a"]), (None, ["bee"]), (1, []), (3, None), (4, ["x", "", "bee"])]
    df = spark.createDataFrame(rows, "doc_id long, forms array<string>").repartition(2)
    blocks = TK.token_blocks(df, ["doc_id"], "forms")
    table = spark.createDataFrame([("bee", "insect"), ("x", ""), ("unused", "u")], "form string, lemma string")
    got = TK.replaced(blocks, table, "lms")
    assert "posexplode(forms" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.lms) for r in got.collect()), key=key) == sorted(
        [(1, ["a", "insect", "a"]), (None, ["insect"]), (1, []), (3, []), (4, ["", "", "insect"])], key=key)


def test_lemmatize_joins_the_rows_of_a_key(spark, tmp_path):
    """Rows of one doc_id are put together token by token, as a window over (doc_id, place) would."""
    from lectern.plans import catalog

    rows = [(1, "wolfhounds run"), (1, "so elephants"), (2, None), (None, "Elephants!"), (3, "...")]
    spark.createDataFrame([(d, "s", t) for d, t in rows], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.lemmatized) for r in catalog.QUERIES["lemmatize"](spark, str(tmp_path)).collect()}
    assert got == {(1, "so wolfho elepha run"), (2, ""), (None, "elepha"), (3, "")}


def test_vectors_get_partitions_by_bytes_and_only_when_asked(spark, monkeypatch):
    from lectern.operators import chunking as CH
    from lectern.plans import answer as AN

    docs = spark.createDataFrame([(i, "t", f"number {i} " * 60) for i in range(40)], "doc_id long, title string, text string")
    calls = []
    real = CH.cluster_parts
    monkeypatch.setattr(CH, "PART_BYTES", 1000)
    monkeypatch.setattr(AN, "cluster_parts", lambda d: calls.append(1) or real(d))
    corpus = AN.build_corpus(docs)
    assert not calls
    size = sum(len(f"number {i} " * 60) for i in range(40))
    assert corpus.vectors.rdd.getNumPartitions() == -(-size // 1000) and calls == [1]
    assert {round(r.w, 6) for r in corpus.vectors.filter("doc_id = 7").collect()} >= {round(0.5 ** 0.5, 6)}


# --- many questions ----------------------------------------------------------------

def test_the_corpus_is_cut_once_for_all_passes(spark, sides, monkeypatch):
    """With several batches of questions the blocks of the corpus are made once, and the result is that of one batch."""
    from lectern.plans import answer as AN

    docs = spark.createDataFrame([(i, "t", f"{t or ''} and a few more words") for i, (_, _, t) in enumerate(sides[0][:200])], "doc_id long, title string, text string")
    q = spark.createDataFrame(sides[1], "qid long, question string")
    cut = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            cut.add(batch.num_rows)
            yield batch

    def top():
        corpus = AN.build_corpus(docs)
        corpus.blocks = corpus.blocks.mapInArrow(counted, corpus.blocks.schema)
        before = cut.value
        rows = top_rows(AN.top_chunks(q, corpus))
        return rows, cut.value - before

    one = top()
    monkeypatch.setattr(AN, "question_blocks", lambda t, k, c, m: TB.term_blocks(t, k, None, c, m, rows=10))
    monkeypatch.setattr(TB, "BATCH_BYTES", 1000)
    monkeypatch.setattr(TB.block_top_k, "__defaults__", (TB.TOP_K, "qid", ("doc_id", "pos"), 1000, *TB.block_top_k.__defaults__[4:]))
    several = top()
    assert one[0] == several[0] and one[0]
    assert one[1] == several[1] > 0


@pytest.mark.parametrize("rare,lined,strip", [(300, 50, 1 << 18), (1, 10**9, 64), (1, 0, 300), (4, 3, 1)])
def test_ways_of_scoring_agree(sides, monkeypatch, rare, lined, strip):
    """Whether a term is scored by the product, by lines or by pairs, the best rows are those in double precision."""
    monkeypatch.setattr(TB, "LINED", lined)
    monkeypatch.setattr(TB, "STRIP", strip)
    tokens = [[(t or "").replace(".", " ").split() for *_, t in side] for side in (sides[1], sides[0])]
    asked, others = plain_block(tokens[0]), plain_block([["a", "w7", "unheard"], ["w7"], []])
    TB._Block.joined([asked, others])
    best = TB._Best(asked.n, 3)
    for first in range(0, 900, 300):
        TB.best_of_block(asked, plain_block(tokens[1][first:first + 300], first), best, rare=rare)
    keys = [(i, 0, t) for i, (*_, t) in enumerate(sides[0])]
    order = np.lexsort((best.key1, -np.rint(best.score * 1e9), best.q))
    rank = np.arange(order.size) - np.searchsorted(best.q[order], best.q[order])
    got = {(sides[1][best.q[i]][0], int(best.key1[i]), 0, int(n) + 1, round(float(best.score[i]), 6)) for i, n in zip(order, rank) if n < 3}
    assert got == brute(sides[1], keys, 3)


def test_rows_without_frequent_terms_dont_make_the_groups():
    """Rows of two vocabularies are told apart though others hold none of the frequent terms."""
    texts_of_rows = [["x", "y", f"r{i}"] for i in range(60)] + [["u", "v", f"s{i}"] for i in range(50)] + [[f"lone{i}"] for i in range(20)]
    held = plain_block(texts_of_rows)
    order, edges = held.arranged(64)
    kinds = [{("xy" if i < 60 else "uv") for i in order[a:z] if i < 110} for a, z in zip(edges[:-1], edges[1:])]
    assert sorted(x for k in kinds for x in k) == ["uv", "xy"] and max(np.diff(edges)) <= 64
    # groups over the most are cut evenly
    assert sorted(np.diff(plain_block([["x"]] * 130).arranged(64)[1])) == [42, 44, 44]


# --- rows of some MB ---------------------------------------------------------------

def large_blocks(spark, n):
    """``n`` written blocks of over 2 MB each, one file."""
    def run(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_pylist([{"block": i, "n": 1, "key1": b"\0" * 8, "key2": b"\0" * 8, "terms": [f"elephants{i}", "a"],
                                                   "starts": np.array([0, 1, 2], "<i4").tobytes(), "rows": b"\0" * 8, "counts": b"\1\0\0\0" * 2 + os.urandom(2 << 20)}],
                                                 pa.schema([("block", pa.int64()), ("n", pa.int32()), ("key1", pa.binary()), ("key2", pa.binary()),
                                                            ("terms", pa.list_(pa.string())), ("starts", pa.binary()), ("rows", pa.binary()), ("counts", pa.binary())]))

    return spark.range(n).coalesce(1).mapInArrow(run, TB.SCHEMA)


def rows_of_groups(path):
    import pyarrow.parquet as pq

    found = [pq.ParquetFile(f).metadata for f in path.rglob("*.parquet") if "checksum" not in f.name]
    return [m.row_group(i).num_rows for m in found for i in range(m.num_row_groups)]


@pytest.mark.parametrize("how", ["stored", "lemmas"])
def test_row_groups_of_blocks_are_small(spark, tmp_path, monkeypatch, how):
    """Writers hold and readers decode a row group as a whole: it has a few blocks, however many a task has."""
    from lectern.operators import lemmas as LM
    from lectern.plans import answer as AN

    if how == "stored":
        docs = spark.createDataFrame([(1, "t", "a few words of one document")], "doc_id long, title string, text string")
        corpus = AN.build_corpus(docs)
        corpus.blocks = large_blocks(spark, 20)
        AN.store_corpus(corpus, str(tmp_path))
        groups = rows_of_groups(tmp_path / "blocks")
    else:
        monkeypatch.setattr(LM, "with_lemmas", lambda blocks, memo: blocks)
        found = LM.Lemmas(f"{tmp_path}/memo", lambda: lambda forms: forms).of_blocks(large_blocks(spark, 20))
        from pathlib import Path

        groups = rows_of_groups(Path(found.inputFiles()[0].replace("file:", "")).parent)
    assert sum(groups) == 20 and max(groups) <= 6


def test_changed_terms_stream_to_their_block(spark):
    """No step gathers a block's changed terms in one value, and blocks across Arrow batches get their own lemmas."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    words = [[f"w{i}x{j}" for j in range(i % 7)] for i in range(40)]
    rows = [{"block": i, "n": 1, "key1": bytes(8), "key2": bytes(8), "terms": ws, "starts": np.arange(len(ws) + 1).astype("<i4").tobytes(),
             "rows": bytes(4 * len(ws)), "counts": np.arange(1, len(ws) + 1).astype("<i4").tobytes()} for i, ws in enumerate(words)]
    blocks = written(spark.createDataFrame([tuple(r.values()) for r in rows], TB.SCHEMA).repartition(3), "blocks")
    memo = [(w, ("two words", "", "same", f"{w}y")[j % 4]) for ws in words for j, w in enumerate(ws) if j != 5] + [("w1x0", None), (None, "x")]
    held = TB.with_lemmas(blocks, spark.createDataFrame(memo, "form string, lemma string"))
    assert "collect_list" not in held._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get(name, None)
    spark.conf.set(name, "3")
    try:
        got = {r.block: r for r in held.collect()}
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    assert len(got) == 40
    for i, ws in enumerate(words):
        want = Counter()
        for j, w in enumerate(ws):
            for x in (w if j == 5 else ("two words", "", "same", f"{w}y")[j % 4]).split():
                want[x] += j + 1
        counts = np.frombuffer(got[i].counts, "<i4").tolist()
        assert dict(zip(got[i].terms, counts)) == want and got[i].n == 1
