"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""
import bisect
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import (byte_bpe, common, exact_dedup, jaccard_join, language_id, line_dedup, packing, queries, suffix_dedup, topk_search,
                         toxicity, warc)
from lectern.session import scratch_path

SF001 = "/root/testdata/sf0.001"
BPE, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(5)
LONG = " ".join(rng.choice(["alpha", "beta", "gamma", "It's", "42", "naïve"]) for _ in range(30_000))
TEXTS = [None, "", "  \n\t", "one two three four five six", "one  two three four five six", "ONE two three four five six",
         "one two three four five six", LONG, LONG, "x" * 5000, "é" * 900 + "🙂", "short line here\nshort line here\nother",
         "<html lang=\"de\">Nicht aulich", "\x1c\x85 a\x00b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, ids string, score double, body string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", len(t or ""), True, "clash", 0.5, "clash") for i, t in enumerate(TEXTS)]
    rows += [(3, TEXTS[3], "en", None, 1, None, None, None, None), (None, "no id at all in this row", None, None, 1, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert byte_bpe.decode(byte_bpe.encode(empty, BPE), BPE).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    root = scratch_path(spark, "warc-empty")
    assert warc.write_archive(pages, root).count() == 0 and warc.read_archive(spark, root).count() == 0
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert packing.pack(packing.pieces(empty, WORDS).drop("ids")).count() == 0
    assert exact_dedup.flags(empty).count() == 0 and exact_dedup.keep(empty).count() == 0
    assert topk_search.top_k(vectors, vectors).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_pretokens_follow_the_pattern():
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.vocabulary(BPE).ranks, special_tokens={})
    alphabet = "ab s t're veml l'd' \n\t é1²٣.,!'́中🙂'S\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", "a" * 4000, " " * 3000, "'" * 90 + "s"]
    for t, (ids, offsets) in zip(texts, byte_bpe.encode_texts(texts, byte_bpe.vocabulary(BPE))):
        assert ids.tolist() == enc.encode_ordinary(t)
        assert byte_bpe.vocabulary(BPE).decode(ids, offsets) == t.encode()


def test_merge_scan_and_rows_agree():
    vocab = byte_bpe.vocabulary(BPE)
    pieces = [bytes(rng.choice(b"abcdeth in") for _ in range(rng.randrange(2, 30))) for _ in range(300)]
    rows = vocab.merge_rows(pieces)
    for p, r in zip(pieces, rows):
        if p not in vocab.ranks:
            assert vocab.merge(p) == r


def test_bpe_round_trip(docs):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.vocabulary(BPE).ranks, special_tokens={})
    for packed in (False, True):
        got = byte_bpe.decode(byte_bpe.encode(docs, BPE, packed=packed), BPE).collect()
        ids = lambda r: np.frombuffer(r.ids, "<u4").tolist() if packed else list(r.ids)
        want = sorted((str(d), enc.encode_ordinary(t or ""), (t or "").encode()) for d, t in pairs(docs))
        assert sorted((str(r.doc_id), ids(r), bytes(r.decoded)) for r in got) == want


def test_exact_dedup(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = pairs(docs)
    got = exact_dedup.flags(docs).collect()
    assert len(got) == len(rows)
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        low = min((x for x in ids if x is not None), default=None)
        assert (r.keep_id, r.group_size) == (low, len(ids))
        assert not r.kept or r.doc_id == low
    assert Counter(r.text_sha256 for r in got if r.kept) == {s: 1 for s in by_sha}
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns and kept.count() == len(by_sha)


def test_line_dedup(docs):
    bare = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    rows, owner = pairs(docs), {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            owner[bare(x)] = min(owner.get(bare(x), 1 << 62), 1 << 61 if d is None else d)
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(bare(x)) < 10 or owner[bare(x)] == (1 << 61 if d is None else d)]
        want.append((str(d), len(lines), len(lines) - len(stay), "\n".join(stay).encode()))
    got = line_dedup.dedup_lines(docs, batches=3, fanout=2).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, bytes(r.kept_text)) for r in got) == sorted(want)


def test_lines_that_end_in_a_line_separator(spark):
    rows = []
    for i, end in enumerate(["\x85", "\u2028", "\u2029"]):
        rows += [(10 * i, f"some words {i} {end}"), (10 * i + 1, f"some words {i}{end}"), (10 * i + 2, f" SOME words {i} {end}\nx")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=1).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {d: int(d % 10 == 2) for d, _ in rows}


def test_line_store_reopens(spark):
    root = scratch_path(spark, "lines")
    batch = lambda ks, i: spark.createDataFrame([(i, hashlib.md5(k.encode()).digest()) for k in ks], "id long, hash binary")
    store = line_dedup.LineStore(spark, root, fanout=2)
    assert store.add(batch("abc", 1)).count() == 3
    assert store.add(batch("cd", 2)).count() == 1
    again = line_dedup.LineStore.open(spark, root, fanout=2)
    assert again.levels == store.levels and [len(x) for x in again.levels] == [0, 1]
    assert again.add(batch("ae", 3)).count() == 1 and again.runs().count() == 5


def test_warc(spark):
    body = "<p>" + "same " * 400
    rows = [(1, "http://a/x y\r\n", body), (7, None, body), (7, "u", body), (3, "http://b/é", None), (4, "u", "tiny"), (5, "u", "tiny"),
            (None, "u", body), (None, "u", "lone " * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = scratch_path(spark, "warc")
    files = warc.write_archive(pages, root, roll_bytes=200)
    assert files.count() > 1
    got = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc.read_archive(spark, root).collect()), key=str)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        again = h == body and p != 7
        want.append((str(p), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 7 if again else None))
    assert got == sorted(want, key=str)
    second = scratch_path(spark, "warc")
    sums = lambda m: sorted((r.name, r.sha256) for r in m.collect())
    assert sums(warc.write_archive(pages.repartition(5), second, roll_bytes=200)) == sums(files)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked_components(rows, k=5):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and 100 * o >= 75 * (len(a) + len(sets[j]) - o):
                up[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), d), d)
    return sorted((d, len(sets[i]), low[top(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k", [1, 5])
def test_jaccard_join(spark, k):
    vocab = [f"w{i}" for i in range(12)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(3, 14))] for _ in range(20)]
    texts = []
    for _ in range(200):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    rows = list(enumerate(texts + [None, "", " \n ", texts[0].upper()]))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
    assert sorted(map(tuple, got)) == linked_components(rows, k)


@pytest.mark.parametrize("most", [64, 1 << 17])
def test_parity_bound_holds(monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "PARITY_MOST", most)
    draw = np.random.default_rng(5)
    for _ in range(300):
        pool = draw.integers(0, 1 << 63, int(draw.integers(1, 400)), dtype=np.uint64)
        x, y = (np.unique(draw.choice(pool, int(draw.integers(1, 300)))) for _ in range(2))
        odd = jaccard_join.differing(jaccard_join.parity_bits(x), jaccard_join.parity_bits(y))
        assert np.intersect1d(x, y).size <= (x.size + y.size - odd) // 2
        assert jaccard_join.differing(jaccard_join.parity_bits(x), jaccard_join.parity_bits(x)) == 0


def test_jaccard_odd_rows(docs):
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert all(r.component_id == 3 for r in got if r.doc_id in (3, 4, 5, 6))
    assert all((r.n_shingles, r.component_id) == (0, r.doc_id) for r in got if r.doc_id in (0, 1, 2))
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_components_on_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    train, rest = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    found = language_id.identify(rest, language_id.fit(train), host=F.col("source")).join(rest, "doc_id").collect()
    assert np.mean([r.language == r.lang for r in found]) > 0.97 and not any(r.rejected for r in found)
    odd = spark.createDataFrame([(1, None), (2, "12 34"), (3, "ⴰⴱⴲ ⴳⴴⴵⴶ ⴷⴸⴹⴺ ⴻⴼⴽ")], "doc_id long, text string")
    assert [r.rejected for r in language_id.identify(odd, language_id.fit(train)).orderBy("doc_id").collect()] == [True, True, True]


def test_language_evidence_from_markup_and_address(spark):
    labelled = spark.createDataFrame([("foo oof ofo", "aa"), ("bar rab arb", "bb")], "text string, lang string")
    model = language_id.fit(labelled)
    rows = [(i, f"http://h{i % 3}.site.xb/p", "bar rab arb") for i in range(30)] + [(i, "//other.xa/", "foo oof ofo") for i in range(30, 90)]
    rows += [(99, "http://h9.site.xb/", "bar foo"), (98, "https://u@OTHER.xa:80/?a", "bar foo"), (97, None, "bar foo"), (96, "mailto:x", "bar foo")]
    pages = spark.createDataFrame(rows, "doc_id long, url string, text string")
    by_host = {r.doc_id: r for r in language_id.identify(pages, model, host=language_id.host_of(F.col("url"))).collect()}
    assert by_host[99].language == "bb"  # unseen host of a known domain
    assert by_host[98].language == by_host[97].language == by_host[96].language == "aa"  # known host; the corpus
    said = language_id.identify(pages, model, declared=F.when(F.col("doc_id") == 97, F.lit("bb"))).filter("doc_id = 97").first()
    assert said.language == "bb"
    assert spark.range(1).select(language_id.markup_language(F.lit('<HTML class=a lang="DE-at">')).alias("x")).first().x == "de"


def test_language_model_holds_every_label(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANG_BLOCK", 64, raising=False)  # three passes
    own = lambda i: " ".join(chr(0x4E00 + 40 * i + j) * 2 + chr(0x4E00 + 40 * i + (j + 7) % 40) for j in range(40))
    rows = [(i, own(i), f"l{i:03d}") for i in range(140)] + [(1000 + i, own(0), "l000") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    langs, counts = language_id.fit(docs)
    assert len(langs) == 140
    said = F.when(F.col("doc_id") == 139, F.lit("l139"))
    found = language_id.identify(docs, (langs, counts), declared=said, host=F.concat("lang", F.lit(".site"))).join(docs, "doc_id").collect()
    assert len(found) == 143 and all(r.language == r.lang and not r.rejected for r in found)


def test_language_sample_is_even_among_copies(spark):
    texts = [" ".join(rng.choice(["foo", "oof", "ofo", "bar"]) for _ in range(9)) + f" t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    key = lambda t: spark.range(1).select(F.pmod(F.xxhash64(F.lit(t)), F.lit(1_000_000))).first()[0]
    hot = next(f"zzz yyy {c}{d}" for c in "abcdefgh" for d in "abcdefghijklm" if key(f"zzz yyy {c}{d}") < 60_000)  # in the sample
    rows = [(t, "aa") for t in texts] + [(hot, "aa")] * 400
    _, counts = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), per_lang=100)
    got = {r.bucket: r.n for r in counts.collect()}
    assert all(got[b] <= 250 for b in language_id.grams("zzz"))  # about 100 texts, not 400 copies
    assert sum(got.values()) > 50 * 20


def test_packing(docs):
    tok = Tokenizer.from_file(WORDS)
    got = packing.pack(packing.pieces(docs, WORDS).withColumn("crc", F.crc32("ids")).drop("ids")).toPandas()
    want = []
    for d, t in pairs(docs):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(d), i, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes())) for i, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.piece, r.start, r.length, r.crc) for r in got.itertuples()) == sorted(want)
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all()
    assert (s.groupby("sequence_id").length.sum() <= 4096).all()


def test_word_ids_match_the_tokenizer():
    tok = Tokenizer.from_file(WORDS)
    odd = ["", "  ", "Café's déjà-vu!!! it's.", "foo<|endoftext|> bar<|ENDOFTEXT|>", "<|startoftext|>x!|> y", "İ, ΣΑΣ. Á. क़.",
           "don't 'll x's! y's's", "ÀÉß÷×µªº²½. ÷ x÷ ÿŸ.", "a\xa0b\x85c\x1cd\tx\r\ny.\n", "word$$$\nnext.###", "é" * 300, "q" * 300, "x≠ =\u0338 y=\u0338"]
    odd += ["".join(rng.choice("abcXYZéÉßÿŸ÷×_'\"!.,-|<> \n\t19²½\xa0\u0301中İΣ\x00") for _ in range(rng.randrange(60))) for _ in range(3000)]
    got = packing.WordIds(WORDS).ids(odd, 1)
    assert [g.tolist() for g in got] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in odd]


def test_packing_plan_is_tight():
    for _ in range(20):
        histogram = {rng.randrange(1, 101): rng.randrange(1, 400) for _ in range(30)}
        p = packing.plan(histogram, 100)
        used, total = Counter(), sum(k * v for k, v in histogram.items())
        for length, n in histogram.items():
            at = np.flatnonzero(p["length"] == length)
            ends = np.append(p["rank"][at][1:], n)
            for i, e in zip(at, ends):
                for j in range(e - p["rank"][i]):
                    used[p["sequence"][i] + j] += length
        assert max(used.values()) <= 100 and sum(used.values()) == total
        spaces = []  # best-fit decreasing, one piece at a time
        for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
            at = bisect.bisect_left(spaces, length)
            space = spaces.pop(at) if at < len(spaces) else 100
            bisect.insort(spaces, space - length)
        assert len(used) <= len(spaces) * 1.01 + 1


def test_top_k(spark):
    r = np.random.default_rng(3)
    mats = r.normal(size=(300, 8)) / 3
    rows = [(i, v.tolist()) for i, v in enumerate(mats)] + [(400, mats[0].tolist()), (401, mats[0].tolist()), (402, None),
                                                           (403, [1.0, None] * 4), (404, [float("nan")] * 8), (405, [1.0]), (None, mats[1].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk_search.top_k(v, v.filter("vec_id % 50 = 0"), 5).collect()))
    ok = [(i, np.floor(256 * np.array(x))) for i, x in rows if i is not None and i < 402]
    want = []
    for q, a in ok:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in ok if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_max_score_drops_nothing():
    r = np.random.default_rng(4)
    c = np.floor(256 * r.normal(size=(5000, 16)) * np.linspace(1, 0.05, 16))
    q = c[:40]
    ids = np.arange(5000)
    got = sorted(zip(*(x.tolist() for x in topk_search.best_in_shard(ids[:40], q, ids, c, 5))))
    want = []
    for i in range(40):
        s = (c @ q[i]).astype(int)
        want += [(i, j, s[j]) for j in [j for j in np.lexsort((ids, -s)) if j != i][:5]]
    assert got == sorted(want)


def brute_repeats(rows, length):
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, bodies):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(d), len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


@pytest.mark.parametrize("most", [1, 5, 256])
def test_suffix_dedup_small_windows(spark, most):
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    rows = [(i, word(rng.randrange(40)) + rng.choice(["", "abbabaababbabaabbaab", "a" * 25, "é" * 12]) + word(rng.randrange(20))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, length=20, classes=(12, 4, 2, 1), most=most).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute_repeats(rows, 20)


def test_suffix_dedup_odd_rows(docs):
    rows = [(d, t) for d, t in pairs(docs) if t is None or len(t) < 10_000]
    got = suffix_dedup.remove_repeats(docs.filter("text IS NULL OR length(text) < 10000")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute_repeats(rows, 400)
    whole = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert whole[7].n_removed == whole[7].n_bytes and whole[8].n_removed == whole[8].n_bytes


def brute_passages(rows, words):
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i:i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for (d, _), w in zip(rows, split):
        inside = np.zeros(len(w) + 2, np.int8)
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i:i + words])] > 1:
                inside[i + 1:i + words + 1] = 1
        edge = np.flatnonzero(np.diff(inside)).tolist()
        out.append((str(d), edge[::2], edge[1::2]))
    return sorted(x for x in out if x[1])


@pytest.mark.parametrize("words,k", [(6, 2), (9, 3), (1, 1)])
def test_repeated_passages_small_windows(spark, words, k):
    word = lambda n: "".join(rng.choice(["a ", "b\n", "\u00e9\x0b \t", "cc "]) for _ in range(n))
    rows = [(i, word(rng.randrange(14)) + rng.choice(["", "cc a cc b cc a a b \u00e9 b ", "a " * 14]) + word(rng.randrange(9))) for i in range(80)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (200, None), (201, ""), (202, " z" * 40), (203, "y\x1cy\x85y " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.repeated_passages(suffix_dedup._rows(docs, "doc_id", "text"), words, k).collect()
    got = {(str(r.doc_id), tuple(r.starts), tuple(r.ends)) for r in found}
    assert got == {(d, tuple(a), tuple(z)) for d, a, z in brute_passages(rows, words)} and len(got) == len(found)


def test_op10_tells_passages_of_50_words(spark, tmp_path):
    """Passages of over 50 words are told though they are under 400 bytes; the contract's columns are those of 400 bytes."""
    r = random.Random(51)

    def words(n):
        return " ".join("".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(n))

    short, passage, tiny, long = words(49), words(54), " ".join(r.choices("abcdefg", k=60)), words(90)
    assert len(tiny) < 200 < len(passage) < 400 < len(long)
    shared = [short, short, passage, passage.replace(" ", "  \n"), tiny, tiny, long, long, "", None]
    rows = [(i, None if s is None else f"{words(70)} {'ABCDEFGHI'[i]}0 {s} 0{'ABCDEFGHI'[i]} {words(70)}") for i, s in enumerate(shared)]
    rows.append((None, passage))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_suffix_dedup(spark, str(tmp_path)).collect()
    assert {x.doc_id: (x.n_passages, x.n_passage_words) for x in got} == {
        0: (0, 0), 1: (0, 0), 2: (1, 54), 3: (1, 54), 4: (1, 60), 5: (1, 60), 6: (1, 90), 7: (1, 90), 8: (0, 0), 9: (0, 0), None: (1, 54)}
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == [
        (*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute_repeats(rows, 400)]


def test_run_index_matching_statistics():
    for _ in range(20):
        texts = list({bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 7))})
        index = suffix_dedup.RunIndex(texts)
        match = index.matching()
        for i, t in enumerate(texts):
            for p in range(len(t)):
                best = 0
                for j, u in enumerate(texts):
                    for q in range(len(u)):
                        n = 0
                        while (i, p) != (j, q) and p + n < len(t) and q + n < len(u) and t[p + n] == u[q + n]:
                            n += 1
                        best = max(best, n)
                assert match[index.firsts[i] + p] == best


def test_toxicity(spark):
    words = ["plain", "words", "in", "a", "row", "calm", "text", "here"]
    bad = ["vile", "awful", "nasty"]
    make = lambda toxic: ". ".join(" ".join(rng.choice(words) for _ in range(6)) + (f" {rng.choice(bad)}" if toxic and i == 1 else "")
                                   for i in range(5))
    rows = [(i, make(i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "vile " * 20_000), (None, "calm")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    out = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in out]) > 0.95
    hit = next(i for i, _, y in rows if y and got[i].predicted)
    assert all(any(b in rows[hit][1][s.start:s.end] for b in bad) for s in got[hit].spans) and got[hit].spans
    assert got[900].predicted == 0 and got[901].predicted == 1 and 0 <= got[None].score <= 1


def test_pipeline_stages(spark, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.materialise(stage(spark, kept, SF001), name)
        assert kept.columns == docs.columns, name
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert not {0, 1, 2} & set(ids)  # no words
    assert 3 in ids and not {4, 5, 6, 8} & set(ids)
    assert corpus_pipeline.pack(spark, kept, SF001).select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, SF001).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()


def test_pipeline_takes_out_passages_by_words_too(spark):
    """Passages of over 50 words are taken out though they are under 400 bytes; long strings of few words too, short ones stay."""
    r = random.Random(50)

    def words(n, size=5):
        return " ".join("".join(r.choices("abcdefghijklmnop", k=size)) for _ in range(n))

    passage, short, long_word = words(54), words(36), "".join(r.choices("abcdefghijklmnop", k=450))
    assert 200 <= len(short) < len(passage) < suffix_dedup.LENGTH
    rows, want = [], {}
    for i, shared in enumerate([passage, passage, short, short, long_word, long_word, "", None]):
        a, b = words(80) + "ABCDEFGH"[i], "QRSTUVWX"[i] + words(80)  # what stands beside a passage differs
        rows.append((i, None if shared is None else a + shared + b))
        want[i] = a + b if shared in (passage, long_word) else rows[-1][1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.text for x in corpus_pipeline.repeats(spark, docs, SF001).collect()} == want
