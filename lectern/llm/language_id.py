"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior over the languages and an unknown
one:

* text: character trigrams of words, hashed to ``BUCKETS`` counts a language,
  fitted on about ``PER_LANG`` distinct labelled texts of each; a long text counts as
  ``EVIDENCE`` trigrams, as its trigrams aren't independent;
* the language that markup declares, weighed by how often each declaration
  agrees with the text in this corpus;
* the address suffix, the registered domain and the host, as one prior: host
  counts are smoothed with the domain's, these with the suffix's and these with
  the corpus's.  Counts are sums of text posteriors (grouped aggregation), and
  a document's own share is taken out of its host's.

Every label is a language of the model, however many there are: the counts are a
written table, and texts are held against ``LANG_BLOCK`` languages a pass, so a
worker never holds more than one block.  Work and rows between the steps grow
with rows times languages.

The unknown language gives every trigram bucket the same chance.  A document is
rejected when it has no word or the unknown language takes more than half of
the posterior.

Defined cases: a null or empty text has no word and is rejected.  Null markup,
address or host say nothing.  Rows that repeat are judged each for itself.
Without labelled texts the language is null and nothing is rejected.  Extra
columns are ignored.  An empty table gives an empty result.
"""
from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_rows, materialise, texts_of, utf8

BUCKETS, PER_LANG, EVIDENCE = 1 << 15, 1500, 150
#: Languages whose likelihoods a worker holds at once (64 MiB), and those it counts before it hands counts on.
LANG_BLOCK = 256
#: Pseudo-counts of the smoothing at each level, share of declarations taken for right beforehand, prior of the unknown.
SMOOTH, TRUST, UNKNOWN = 8.0, 0.9, 0.01


def markup_language(html: Column) -> Column:
    """The language that markup declares (primary subtag), or null."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Buckets of the trigrams of all words, a blank on either side of a word."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    letter = _letters()[codes]
    codes[~letter] = 32
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # of the signs between two words the one before the second
    keep[1:] |= letter[:-1]  # and the one behind the first
    codes, letter = codes[keep], letter[keep]
    if codes.size < 3:
        return np.zeros(0, np.int64)
    x = (codes[:-2] * np.uint64(961) + codes[1:-1] * np.uint64(217) + codes[2:]) * np.uint64(0x9E3779B1) >> np.uint64(7)
    return (x & np.uint64(BUCKETS - 1)).astype(np.int64)[letter[1:-1]]


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], DataFrame | None]:
    """(languages, their trigram counts as a written table (lang, bucket, n)) from (text, lang)."""
    rows = labelled.select("text", "lang", F.xxhash64("text").alias("key")).filter("lang IS NOT NULL AND text IS NOT NULL")
    # equal texts are drawn together, so they count once, in the size of a language and in its sample
    sizes = rows.groupBy("lang").agg(F.count("*").alias("c"), F.approx_count_distinct("key", 0.02).alias("d"))
    sizes = materialise(sizes.select("lang", F.when(F.col("c") <= per_lang, F.col("c")).otherwise(F.col("d")).alias("c")), "lang-sizes")
    langs = sorted(r["lang"] for r in sizes.select("lang").collect())  # one row a language
    if not langs:
        return [], None
    million = F.lit(1_000_000)
    limit = F.ceil(million * F.least(F.lit(1.0), F.lit(per_lang) / F.col("c")))
    drawn = (rows.join(F.broadcast(sizes), "lang").filter(F.pmod("key", million) < limit).dropDuplicates(["lang", "key"])
             .select("lang", utf8(F.col("text")).alias("body")))

    def run(batches):
        counts = {}

        def hand_on():
            for lang, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array(at), pa.array(c[at])],
                                                 ["lang", "bucket", "n"])
            counts.clear()

        for batch in batches:
            for lang, body in zip(batch.column("lang").to_pylist(), texts_of(batch.column("body"))):
                if lang not in counts and len(counts) == LANG_BLOCK:
                    yield from hand_on()
                to = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                to += np.bincount(grams(body), minlength=BUCKETS)
        yield from hand_on()

    found = drawn.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return langs, materialise(found, "lang-counts")


def _likelihoods(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """Log-likelihood of every bucket by language."""
    found = counts.filter(F.col("lang").isin(langs)).toArrow()  # at most BUCKETS rows a language
    table = np.full((BUCKETS, len(langs)), 0.2)
    at = pa.compute.index_in(found.column("lang"), value_set=pa.array(langs, pa.string())).to_numpy()
    table[found.column("bucket").to_numpy(), at] += found.column("n").to_numpy()
    return np.log(table / table.sum(0))


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _matrix(column: pa.Array, width: int, fill=0.0) -> np.ndarray:
    """The lists of a column as rows of a matrix; a null list gives ``fill``."""
    out = np.empty((len(column), width))
    out[:] = fill
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _text_evidence(rows: DataFrame, langs: list[str], counts: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, grams, and per language and the unknown one the tempered log-likelihood (ll), and the text posteriors (post).

    Pass by pass over blocks of languages; the texts travel along until the last one.
    """
    kinds = dict(rows.dtypes)
    blocks = [langs[a:a + LANG_BLOCK] for a in range(0, len(langs), LANG_BLOCK)]
    seen, done = rows, 0
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        shared = rows.sparkSession.sparkContext.broadcast(_likelihoods(counts, block))

        def run(batch: pa.RecordBatch, shared=shared, done=done, last=last):
            found = [grams(t) for t in texts_of(batch.column("body"))]
            count = np.array([g.size for g in found], np.int64)
            temper = np.minimum(1, EVIDENCE / np.maximum(count, 1))[:, None]
            ll = np.empty((len(found), shared.value.shape[1]))
            for j, g in enumerate(found):
                bucket, times = np.unique(g, return_counts=True)  # a long text has no more than BUCKETS
                ll[j] = np.einsum("i,ij->j", times.astype(np.float64), shared.value[bucket])
            ll *= temper
            if done:
                ll = np.hstack([_matrix(batch.column("ll"), done), ll])
            have = [batch.column(c) for c in keep]
            if not last:
                yield pa.RecordBatch.from_arrays([*have, batch.column("body"), _lists(ll)], [*keep, "body", "ll"])
                return
            ll = np.hstack([ll, -np.log(BUCKETS) * count[:, None] * temper])
            ll -= ll.max(1, keepdims=True)
            post = np.exp(ll[:, :-1])
            post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
            yield pa.RecordBatch.from_arrays([*have, pa.array(count), _lists(ll), _lists(post)], [*keep, "grams", "ll", "post"])

        schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep),
                            *(["grams long", "ll array<double>", "post array<double>"] if last else ["body binary", "ll array<double>"])])
        seen = materialise(map_rows(seen, run, schema, "body"), "lang-text")
        shared.unpersist()
        done += len(block)
    return seen


def _smooth(own: np.ndarray, parent: np.ndarray) -> np.ndarray:
    return (own + SMOOTH * parent) / (own.sum(1, keepdims=True) + SMOOTH)


def identify(docs: DataFrame, model: tuple[list[str], DataFrame | None], doc_id: str = "doc_id", text: str = "text",
             declared: Column | None = None, host: Column | None = None) -> DataFrame:
    """Per row: doc_id, row_key (hash of id and text), language, posterior, rejected."""
    langs, counts = model
    none = F.lit(None).cast("string")
    host = none if host is None else host.cast("string")
    labels = F.split(host, r"\.")
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key"),
        utf8(F.col(text)).alias("body"), (none if declared is None else declared).alias("declared"), host.alias("host"),
        F.when(F.size(labels) > 1, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).alias("domain"),
        F.when(F.size(labels) > 1, F.element_at(labels, -1)).alias("suffix"))
    if not langs:
        return rows.select("doc_id", "row_key", none.alias("language"), F.lit(None).cast("double").alias("posterior"),
                           F.lit(False).alias("rejected"))
    n = len(langs)
    seen = _text_evidence(rows, langs, counts, ["doc_id", "row_key", "declared", "host", "domain", "suffix"])
    told = seen.filter("grams > 0")

    def sums(of: DataFrame, key: list[str], column: str, name: str) -> DataFrame:
        """The sum of the lists of a key, element by element."""
        whole = of.groupBy(*key).agg(*(F.sum(F.get(column, F.lit(i))).alias(f"_{i}") for i in range(n)))
        return whole.select(*key, F.array(*(F.coalesce(f"_{i}", F.lit(0.0)) for i in range(n))).alias(name))

    whole = np.array(sums(told, [], "post", "w").first()["w"])
    corpus = (whole + SMOOTH / n) / (whole.sum() + SMOOTH)

    # suffix -> domain -> host, each level written once
    hosts = materialise(sums(told.filter("host IS NOT NULL"), ["host", "domain", "suffix"], "post", "h"), "lang-host-sums")
    tree = (hosts.join(sums(hosts.filter("domain IS NOT NULL"), ["domain"], "h", "d"), "domain", "left")
            .join(sums(hosts.filter("suffix IS NOT NULL"), ["suffix"], "h", "s"), "suffix", "left").select("host", "h", "d", "s"))

    def prior_of_hosts(batch: pa.RecordBatch):
        prior = _smooth(_matrix(batch.column("d"), n), _smooth(_matrix(batch.column("s"), n), corpus))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("h"), _lists(prior)], ["host", "h", "dp"])

    tree = materialise(map_rows(tree, prior_of_hosts, "host string, h array<double>, dp array<double>"), "lang-hosts")
    said = materialise(sums(told.filter("declared IS NOT NULL"), ["declared"], "post", "c"), "lang-declared")

    def judge(batch: pa.RecordBatch):
        ll, post = _matrix(batch.column("ll"), n + 1), _matrix(batch.column("post"), n)
        # a document's own share is taken out of its host's and its declaration's
        prior = _smooth(np.maximum(_matrix(batch.column("h"), n) - post, 0), _matrix(batch.column("dp"), n, corpus))
        claim = batch.column("declared").is_valid().to_numpy(zero_copy_only=False)[:, None]
        right = np.full(ll.shape, (1 - TRUST) / n)
        known = pa.compute.index_in(batch.column("declared"), value_set=pa.array(langs, pa.string()))
        named = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
        right[named, known.drop_null().to_numpy()] = TRUST
        mine = np.maximum(_matrix(batch.column("c"), n) - post, 0)
        z = ll.copy()
        z[:, :n] += np.log(prior) + np.where(claim, np.log((mine + SMOOTH * right[:, :n]) / (whole + SMOOTH)), 0)
        # the unknown language has no opinion on declarations
        z[:, n:] += np.log(UNKNOWN) + np.where(claim, np.log((1 - TRUST) / n), 0)
        e = np.exp(z - z.max(1, keepdims=True))
        e /= e.sum(1, keepdims=True)
        best = e[:, :n].argmax(1)
        none_there = batch.column("grams").to_numpy() == 0
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(langs, pa.string()).take(pa.array(best)),
             pa.array(e[np.arange(best.size), best]), pa.array(none_there | (e[:, n] > 0.5))],
            ["doc_id", "row_key", "language", "posterior", "rejected"])

    joined = seen.join(tree, "host", "left").join(said, "declared", "left").select(
        "doc_id", "row_key", "declared", "grams", "ll", "post", "h", "dp", "c")
    return map_rows(joined, judge, "doc_id long, row_key long, language string, posterior double, rejected boolean")
