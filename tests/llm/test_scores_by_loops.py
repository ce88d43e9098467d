"""Scores of toxicity and top-k search against plain loops, on repeated rows and clashing columns."""
import math
import random

import numpy as np
import pytest

from lectern.llm import topk_search, toxicity

rng = random.Random(23)
CALM, BAD = ["plain", "words", "in", "a", "row", "calm", "text"], ["vile", "awful", "nasty"]


def noisy_or(model: toxicity.Model, text: str) -> float:
    """One minus the chance that no sentence is toxic, sentence by sentence."""
    clean = 1.0
    for sentence in [m.group() for m in toxicity.SENTENCE.finditer(text)] or [""]:
        z = model.bias
        for word in {w for w in toxicity.WORD.findall(sentence.lower()) if w in model.index}:
            z += model.weights[model.index[word]]
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_toxicity_is_a_noisy_or_of_all_sentences(spark):
    make = lambda bad: ". ".join(" ".join(rng.choices(CALM, k=5)) + f" {rng.choice(BAD)}" * (bad and i == 2) for i in range(4))
    rows = [(i, make(i % 4 == 0)) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "  \n"), (403, "VILE! Vile? vile\nvile"), (404, "calm"), rows[0], rows[0], (8, rows[1][1])]
    schema = "doc_id long, text string, score double, label int, predicted int, spans string, body string, held_out string"
    docs = spark.createDataFrame([(*r, 9.0, 1, 7, "clash", "clash", "clash") for r in rows], schema)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0, "clash") for i in range(300)], "doc_id long, toxic int, quality int, text string")
    model = toxicity.fit(docs, labels)
    got = sorted((r.doc_id, r.score, r.predicted) for r in toxicity.score(docs, model).collect())
    want = sorted((d, noisy_or(model, t or "")) for d, t in rows)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)
    assert all(p == (s >= toxicity.THRESHOLD) for _, s, p in got) and 0 < sum(p for *_, p in got) < len(got)


def test_top_k_with_repeated_rows_and_clashing_columns(spark):
    rows = [(i % 90, [rng.randrange(-3, 4) / 8 for _ in range(6)]) for i in range(120)]  # 30 ids twice, many ties
    rows += [rows[0], rows[0], (200, None), (201, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (202, [math.nan] * 6), (203, [0.25, 0.5]), (None, [0.5] * 6)]
    schema = "vec_id long, embedding array<double>, id int, vec string, score long, rank int, block long, query_id long"
    vectors = spark.createDataFrame([(*r, 1, "clash", 2, 3, 4, 5) for r in rows], schema)
    queries = vectors.filter("vec_id in (5, 33, 70, 203)")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_k(vectors, queries, 5).collect()}
    good = [(d, [math.floor(256 * x) for x in v]) for d, v in rows
            if d is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {d: {tuple(v) for e, v in good if e == d} for d in (5, 33, 70, 203)}
    for q, forms in asked.items():
        mine = sorted((k, d, s) for e, k, d, s in got if e == q)
        one_of = []
        for form in forms:  # an id that repeats asks once, with one of its vectors
            best = sorted((-sum(a * b for a, b in zip(form, v)), d) for d, v in good if d != q and len(v) == len(form))[:5]
            one_of.append([(k, d, -s) for k, (s, d) in enumerate(best, 1)])
        assert mine in one_of


@pytest.mark.parametrize("groups, size, share", [(10, 0, 0.5), (200, 0, 1.0), (0, 1, 1.0), (40, 1, 1.0)])
def test_max_score_reads_fewer_postings_and_loses_no_score(groups, size, share):
    r = np.random.default_rng(groups)
    c = r.normal(size=(3000, 32)) * (size or 0.05)
    if groups:
        c += 3 * r.normal(size=(groups, 32))[r.integers(0, groups, 3000)]
    c = np.floor(64 * c)
    c[7] = c[8] = c[9]  # ties
    c = c[topk_search.arranged(c)]
    ids, tally = r.permutation(3000), {}
    got = sorted(zip(*(x.tolist() for x in topk_search.best_in_shard(ids[:100], c[:100], ids, c, 5, tally))))
    want = []
    for i in range(100):
        score = (c @ c[i]).astype(np.int64)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        want += [(ids[i], ids[j], score[j]) for j in order]
    assert got == sorted(want)
    assert tally["postings"] == 100 * 32 * 3000 and tally["read"] <= share * tally["postings"]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 129, 1000])
def test_arranged_is_an_order_of_all_rows(n):
    rows = np.random.default_rng(n).integers(-2, 3, size=(n, 4)).astype(float)
    assert sorted(topk_search.arranged(rows).tolist()) == list(range(n))


def test_max_score_beyond_doubles_and_with_few_candidates():
    c = np.array([[2.0 ** 40, 1.0], [2.0 ** 40, 2.0], [-2.0 ** 40, 3.0]])
    got = [x.tolist() for x in topk_search.best_in_shard(np.array([0]), c[:1], np.arange(3), c, 5)]
    assert got == [[0, 0], [1, 2], [(1 << 63) - 1, -(1 << 63) + 1]]
