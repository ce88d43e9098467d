"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic
function of the listed words it holds, and the document's is their noisy-or,
1 - prod(1 - p).  Training sees document labels only: the gradient of the
noisy-or likelihood gives each sentence its share of the blame, so the model
learns which sentences offend and can point at them.

Fitting uses at most about ``SAMPLE`` labelled documents of each class, chosen
by a hash of the id and weighted back to the class sizes.  Words are chosen
from the sample by the G statistic of their counts by label.

Defined cases: a null or empty text is one empty sentence and gets the score of
the bias alone.  Null labels are not used; an id with several labels takes
their rounded mean.  A null id is never held out.  Without labelled documents
of both classes every score is 0.  Extra columns are ignored.  An empty table
gives an empty result.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_rows, texts_of, utf8

SAMPLE, WORDS, LEAST_DOCS, LEAST_G = 6000, 1024, 6, 15.0
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> tuple[DataFrame | None, dict[int, float]]:
    """(label, body) of the sampled documents and the weight of each class."""
    marked = (labels.select(F.col(doc_id).cast("bigint").alias("id"), F.col("toxic").cast("double").alias("t"))
              .filter(F.col("id").isNotNull() & F.col("t").isNotNull() & (remainder(F.col("id")) != 2))
              .groupBy("id").agg(F.round(F.avg("t")).cast("int").alias("label")).filter("label IN (0, 1)"))
    sizes = {r["label"]: r["c"] for r in marked.groupBy("label").agg(F.count("*").alias("c")).collect()}
    if set(sizes) != {0, 1}:
        return None, {}
    share = {y: min(1.0, SAMPLE / n) for y, n in sizes.items()}
    million = 1_000_000
    draw = F.pmod(F.xxhash64("id"), F.lit(million))
    limit = F.when(F.col("label") == 1, F.lit(int(share[1] * million))).otherwise(F.lit(int(share[0] * million)))
    chosen = marked.filter(draw < limit).limit(4 * SAMPLE)  # about 2 * SAMPLE ids: small enough for every executor
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), utf8(F.col(text)).alias("body"))
    return rows.join(F.broadcast(chosen), "id").select("label", "body"), {y: 1 / s for y, s in share.items()}


def _choose_words(sample: DataFrame, weight: dict[int, float]) -> list[str]:
    def run(batch: pa.RecordBatch):
        seen: dict[str, list[int]] = {}
        for y, body in zip(batch.column("label").to_pylist(), texts_of(batch.column("body"))):
            for w in set(WORD.findall(body.lower())):
                seen.setdefault(w, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen)), pa.array([c[0] for c in seen.values()], pa.int64()),
             pa.array([c[1] for c in seen.values()], pa.int64())], ["word", "clean", "toxic"])

    counts = map_rows(sample, run, "word string, clean long, toxic long", "body").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = {r["label"]: r["c"] for r in sample.groupBy("label").agg(F.count("*").alias("c")).collect()}
    n, total = (F.col("clean") + F.col("toxic")), sum(totals.values())
    g = sum(F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * total / (n * totals[y]))).otherwise(F.lit(0.0))
            for c, y in (("clean", 0), ("toxic", 1)) if totals.get(y))
    top = (counts.filter(n >= LEAST_DOCS).withColumn("g", 2 * g).filter(F.col("g") > LEAST_G)
           .orderBy(F.desc("g"), "word").limit(WORDS).select("word"))
    return [r[0] for r in top.collect()]


def sentences(text: str, index: dict[str, int]) -> tuple[int, list[tuple[int, int, frozenset[int]]]]:
    """(number of sentences, those holding listed words as (start, end, words))."""
    spans = [m.span() for m in SENTENCE.finditer(text)]
    found = []
    for a, b in spans:
        has = frozenset(index[w] for w in WORD.findall(text[a:b].lower()) if w in index)
        if has:
            found.append((a, b, has))
    return max(1, len(spans)), found


class Model:
    """Weights of the listed words and the bias of a sentence."""

    def __init__(self, words: list[str], weights: np.ndarray, bias: float):
        self.index = {w: i for i, w in enumerate(words)}
        self.weights, self.bias = weights, bias

    def sentence(self, has) -> float:
        z = self.bias + sum(self.weights[i] for i in has)
        return 1 / (1 + np.exp(-z))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and (start, end, probability) of the sentences that hold listed words."""
        words = set(WORD.findall(text.lower()))
        if words.isdisjoint(self.index):
            n, found = max(1, sum(1 for _ in SENTENCE.finditer(text))), []
        else:
            n, found = sentences(text, self.index)
        spans = [(a, b, self.sentence(has)) for a, b, has in found]
        clean = (n - len(spans)) * np.log1p(-self.sentence(())) + sum(np.log1p(-min(p, 1 - 1e-12)) for _, _, p in spans)
        return float(-np.expm1(clean)), spans


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", steps: int = 400,
        rate: float = 0.05, decay: float = 2e-3) -> Model | None:
    """Learn from the labelled documents that aren't held out."""
    sample, weight = _sample(docs, labels, doc_id, text)
    if sample is None:
        return None
    words = _choose_words(sample, weight)
    index = {w: i for i, w in enumerate(words)}

    def run(batch: pa.RecordBatch):
        out = [[], [], [], []]
        for y, body in zip(batch.column("label").to_pylist(), texts_of(batch.column("body"))):
            n, found = sentences(body, index)
            kinds: dict[frozenset[int], int] = {}
            for _, _, has in found:
                kinds[has] = kinds.get(has, 0) + 1
            for to, v in zip(out, (y, n - len(found), [sorted(h) for h in kinds], list(kinds.values()))):
                to.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.list_(pa.int32()))),
             pa.array(out[3], pa.list_(pa.int64()))], ["label", "plain", "kinds", "times"])

    bags = map_rows(sample, run, "label int, plain long, kinds array<array<int>>, times array<long>", "body").collect()
    if not bags:
        return None
    return Model(words, *_train(bags, len(words), weight, steps, rate, decay))


def _train(bags, n_words: int, weight: dict[int, float], steps: int, rate: float, decay: float):
    """Adam on the weighted noisy-or likelihood; sentences without listed words share one probability."""
    y = np.array([b["label"] for b in bags], float)
    w_doc = np.array([weight[b["label"]] for b in bags])
    w_doc /= w_doc.sum()
    plain = np.array([b["plain"] for b in bags], float)
    bag = np.repeat(np.arange(len(bags)), [len(b["kinds"]) for b in bags])
    times = np.array([t for b in bags for t in b["times"]], float)
    lists = [k for b in bags for k in b["kinds"]]
    sent = np.repeat(np.arange(len(lists)), [len(k) for k in lists])
    word = np.array([i for k in lists for i in k], np.int64)
    theta = np.append(np.zeros(n_words), -6.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(sent, theta[word], len(lists))
        p, p0 = sigmoid(z), sigmoid(theta[-1])
        log_clean = plain * np.log1p(-p0) + np.bincount(bag, times * np.log1p(-p), len(bags))
        toxic = np.maximum(-np.expm1(log_clean), 1e-9)
        share = w_doc * np.where(y > 0.5, (1 - toxic) / toxic, -1.0)  # of every sentence's p
        g_sent = share[bag] * times * p
        grad = np.append(np.bincount(word, g_sent[sent], n_words), g_sent.sum() + (share * plain * p0).sum())
        grad[:-1] -= decay * theta[:-1] / max(1, n_words) ** 0.5 * 0.1
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, spans (sentences at or over the threshold, in code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        scores, spans = [], []
        for body in texts_of(batch.column("body")):
            s, found = shared.value.score(body) if shared.value else (0.0, [])
            scores.append(min(1.0, max(0.0, s)))
            spans.append([{"start": a, "end": b, "score": float(p)} for a, b, p in found if p >= threshold])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                                         ["doc_id", "score", "spans"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), utf8(F.col(text)).alias("body"))
    found = map_rows(rows, run, "doc_id long, score double, spans array<struct<start:long,end:long,score:double>>", "body")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
