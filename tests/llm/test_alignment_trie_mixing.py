"""Tokenizer alignment, prefix trie and mixing against brute force, with odd rows and small bounds."""
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import mixing, prefix_trie, token_alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
rng = random.Random(11)
TEXTS = [None, "", " ", "\n\t ", "plain words, twice twice", "plain words, twice twice", "naïve façade — “quoted”… 12345 67", "  leading and  double  ",
         "<|endoftext|> <s> </s> <unk> <0x41> as text", "with ▁ inside", "日本語のテキスト и русский", "🙂👩‍👩‍👧 emoji", "tab\tand\r\nline\x0b\x0c\x85 end",
         "\x00null\x01", "x" * 3000, " ".join(rng.choice(["alpha", "beta", "Über", "it's", "42"]) for _ in range(20_000))]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- tokenizer alignment -------------------------------------------------------

def tokens_of(texts):
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    signs = {i: s for s, i in json.load(open(A_PATH, encoding="utf-8"))["model"]["vocab"].items()}
    shown = [x for x in range(256) if 33 <= x < 127 or 161 <= x < 173 or 174 <= x]
    rest = iter(range(256, 512))
    back = {(chr(x) if x in shown else chr(next(rest))): x for x in range(256)}
    out = []
    for t in texts:
        whole = (" " + (t or "")).encode()
        ids_a, ids_b = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        bytes_a = [bytes(back[c] for c in signs[i]) for i in ids_a]
        bytes_b = []
        for i in ids_b:
            p = b.id_to_piece(i)
            bytes_b.append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) and b.is_byte(i) else p.replace("▁", " ").encode())
        out.append(([], []) if not t or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole else
                   (list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b))))
    return out


def spans(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute_alignment(rows):
    found, counts = [], Counter()
    for (doc, _), (a, b) in zip(rows, tokens_of([t for _, t in rows])):
        a, b = spans(a), spans(b)
        ends = {z for _, _, z in a} & {z for _, _, z in b}
        groups, i, j = [], 0, 0
        for e in sorted(ends):
            g = [[], []]
            while i < len(a) and a[i][2] <= e:
                g[0].append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][2] <= e:
                g[1].append(str(b[j][0]))
                j += 1
            groups.append(",".join(g[0]) + "|" + ",".join(g[1]))
        links, j = Counter(), 0
        for x, lo, hi in a:
            while j < len(b) and b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                links[x, b[k][0]] += 1
                k += 1
        counts.update(links.keys())
        found.append((doc, len(a), len(b), len(groups), links, ";".join(groups)))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return sorted(((d, na, nb, ng, sum(k.values()), sum(u for p, u in k.items() if counts[p] == top[p[0]]), sum(counts[p] * u for p, u in k.items()),
                    sha(g) if g else "") for d, na, nb, ng, k, g in found), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("bound", [1 << 22, 10])
def test_alignment(spark, bound):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (None, "an id is missing")]
    docs = spark.createDataFrame([(d, t, 1, "clash", 2) for d, t in rows], "doc_id long, text string, n_a long, groups string, pairs long")
    got = token_alignment.alignment(docs, A_PATH, B_PATH, broadcast_pairs=bound).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute_alignment(rows)


def test_alignment_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = token_alignment.alignment(docs, A_PATH, B_PATH).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute_alignment(rows)


def test_alignment_keeps_groups(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.groups for r in token_alignment.align(docs, A_PATH, B_PATH).collect()}
    assert got[1].count(";") + 1 == 2 and got[2] == ""
    assert token_alignment.alignment(docs.limit(0), A_PATH, B_PATH).count() == 0


def test_plain_code_points_split_alike():
    side = token_alignment.ByteLevelSide(A_PATH)
    slow = side.tokenizer
    for c in [*range(0x250), *range(0x2010, 0x2028)]:
        t = "a{0}b 1{0}2 {0}{0}  {0} \n{0}'s{0}'{0} !{0}?{0}".format(chr(c))
        assert token_alignment.PLAIN.fullmatch(t)
        assert side.fast.encode_ordinary(" " + t) == slow.encode(" " + t, add_special_tokens=False).ids, hex(c)


# --- prefix trie ---------------------------------------------------------------

def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, v in members.items():
        own_saved = (len(v) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own_saved
            leaves[k[:d]] += kids[k] == 0
    return sorted(((min(v), len(k), min(members[k[:-1]]) if k else None, len(v), kids[k], leaves[k], saved[k],
                    sha(",".join(map(str, sorted(c for c in v if len(whole[c]) == len(k)))))) for k, v in members.items()), key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], "conv_id long, turn long, role string, text string, m long, d long, path string")


TURNS = [("user", "hi"), ("bot", "hello"), ("user", None), (None, "hi"), (None, None), ("bot", "Grüße 🙂"), ("user", "x" * 2000)]


def random_rows(seed, n, longest=14):
    r, rows = random.Random(seed), []
    for c in range(-n // 3, n):
        if r.random() < 0.2:
            continue
        like = r.randrange(4)
        script = random.Random(like)
        for t in range(r.randrange(1, longest)):
            role, text = TURNS[script.randrange(3)] if r.random() < 0.9 else TURNS[r.randrange(len(TURNS))]
            rows.append((c, t, role, text))
    r.shuffle(rows)
    return rows


def check_trie(spark, rows):
    got = prefix_trie.conversation_trie(conversations(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_random(spark):
    check_trie(spark, random_rows(1, 120))


def test_trie_small_shards_and_blobs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", 5)
    monkeypatch.setattr(prefix_trie, "BLOB_BYTES", 8)
    check_trie(spark, random_rows(2, 90))


def test_trie_odd_rows(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(12)]  # a group of copies
    rows += [(7, t, "user", f"long {t % 3}") for t in range(900)]  # half of all rows
    rows += [(0, None, "user", "first"), (0, 0, None, None), (1, None, None, "x"), (1, None, None, "x"), (2, 3, "user", "tie"), (2, 3, "user", "tie")]
    rows += [(None, 1, "user", "no conversation"), (-3, 0, "user", "below zero"), (-5, 1, "user", "below zero"), (2**62, 0, "a", "b")]
    check_trie(spark, rows)


def test_trie_empty(spark):
    assert prefix_trie.conversation_trie(conversations(spark, [])).count() == 0


def test_findclose():
    r = np.random.default_rng(3)
    for n in (1, 2, 30, 500, 3000):
        for lean in (0.5, 0.9):
            seq, depth = [], 0
            while len(seq) < 2 * n:
                up = depth == 0 or (r.random() < lean and len(seq) + depth < 2 * n)
                seq.append(up)
                depth += 1 if up else -1
            seq += [False] * depth
            seq = np.array(seq)
            stack, want = [], {}
            for i, x in enumerate(seq):
                if x:
                    stack.append(i)
                else:
                    want[stack.pop()] = i
            opened = np.flatnonzero(seq)
            assert prefix_trie.Parens(seq).findclose(opened).tolist() == [want[i] for i in opened.tolist()]


# --- mixing ---------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = Decimal(sum(sizes.values())) * 3 / 2, set()
    while True:
        rest = total - sum(2 * sizes[s] for s in stopped)
        share = sum(weight[s] for s in order if s not in stopped)
        target = {s: Decimal(2 * sizes[s]) if s in stopped else rest * weight[s] / share for s in order}
        more = {s for s in order if target[s] > 2 * sizes[s]}
        if not more:
            return target
        stopped |= more


def check_mix(spark, rows):
    docs = spark.createDataFrame([(d, s, t, 9, 9, 0.5) for d, s, t in rows], "doc_id long, source string, text string, size long, copies long, target double")
    got = [r.asDict() for r in mixing.mix(docs, carry=False).collect()]
    assert len(got) == len(rows)
    size = Counter()
    for _, s, t in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = brute_targets(size)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(float(target[r["source"]]), rel=1e-12)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        drawn = int(hashlib.md5(f"mix-1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        assert r["copies"] == int(rate) + (drawn < rate - int(rate)) <= 2
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, _, t in rows)
    return docs, got, target


def test_mix(spark):
    rows = [(i, rng.choice(["a", "b", "c", "é", "z", "\U0001f600", "￮", None, ""]), " w" * rng.randrange(60)) for i in range(600)]
    rows += [(1000 + i, "hot", "many words in here \x0b\x1c") for i in range(400)] + [(5, "a", None), (None, None, "\x85 x"), (5, "b", "  "), (5000, "void", "")]
    docs, got, target = check_mix(spark, rows)
    again = mixing.mix(docs.repartition(7, "text"), carry=False).collect()
    assert Counter(map(tuple, again)) == Counter(tuple(r.values()) for r in got)
    out = mixing.emit(mixing.mix(docs)).collect()
    assert Counter((r.doc.doc_id, r.doc.source) for r in out) == Counter({k: n for k, n in (
        lambda c: c.items())(sum((Counter({(r["doc_id"], r["source"]): r["copies"]}) for r in got), Counter())) if n})
    taken = sum(r["copies"] * r["size"] for r in got if r["source"] == "hot")
    assert taken == pytest.approx(float(target["hot"]), rel=0.15)


def test_mix_small(spark):
    check_mix(spark, [(1, "only", "one two three")])
    check_mix(spark, [(1, "a", ""), (2, None, None)])
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string"), carry=False).count() == 0
    assert mixing.emit(mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string"))).count() == 0


def test_mix_is_native(spark):
    docs = spark.createDataFrame([(1, "a", "x y")], "doc_id long, source string, text string")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_places(spark):
    values = spark.createDataFrame([(x,) for x in ["b", None, "a", "é", "\U0001f600", "￮", "", "B"]], "v string")
    got = {r.v: r.place for r in mixing.places(values, "v", "places").collect()}
    assert sorted(got, key=got.get) == ["", "B", "a", "b", "é", "￮", "\U0001f600", None]
