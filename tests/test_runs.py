"""Generation runs, conversations, running totals and the answer stream."""
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.operators import conversations as H
from lectern.operators import inference as I
from lectern.operators.running import running_totals
from lectern.plans.answer import Options, run_questions, run_summary
from lectern.session import written

SF001 = "/root/testdata/sf0.001"


# --- inference ---------------------------------------------------------------------

def test_profiles_and_seeds_reach_the_model(spark):
    def make_telling(profile):
        """Says what reached it: the profile and the row's seed."""
        def predict(prompts, seeds):
            return {"text": [f"{profile.max_new_tokens} {profile.do_sample} {profile.temperature} {profile.top_p} {profile.repetition_penalty} {s}"
                             for s in seeds.tolist()], "tokens": [len(p) for p in prompts]}

        return predict

    df = spark.createDataFrame([(i, f"prompt {i % 7}") for i in range(50)] + [(99, None)], "qid long, prompt string")
    runs = []
    for parts, batch in ((1, 8), (5, 3)):
        got = I.generate_batch(df.repartition(parts), "prompt", make_telling, I.PROFILE_CONTEXT, "gen", batch).collect()
        runs.append({r.qid: (r.gen.text, r.gen.tokens) for r in got})
        assert all(r.gen.seconds >= 0 for r in got)
    assert runs[0] == runs[1]  # the same sample under any partitioning
    assert runs[0][0][0].startswith("64 True 0.7 0.9 None ") and runs[0][0] == runs[0][7] and runs[0][0] != runs[0][1]
    assert len({t for t, _ in runs[0].values()}) == 8
    other = I.Profile(1, False, seed=5)
    assert I.generate_batch(df, "prompt", make_telling, other, "gen").first().gen.text.startswith("1 False None None None ")
    assert df.select(I.row_seed("prompt", 5)).first() != df.select(I.row_seed("prompt")).first()


@pytest.mark.parametrize("route,start", [("context", "64 True"), ("plain", "48 False"), ("strict", "48 False")])
def test_routes_pass_their_profile(spark, route, start):
    from lectern.plans.answer import load_benchmark_questions, load_corpus_from_documents

    def make(profile):
        def predict(prompts, seeds):
            return [f"{profile.max_new_tokens} {profile.do_sample} is the profile" for _ in prompts]

        return predict

    def make_broken(profile):
        return lambda prompts, seeds: ["?" for _ in prompts]

    gens = I.Generators(**({"context": make} if route == "context" else {"plain": make} if route == "plain" else {"plain": lambda p: lambda a, b: ["слово"] * len(a), "strict": make}))
    corpus = load_corpus_from_documents(spark, SF001) if route == "context" else None
    run = written(run_questions(load_benchmark_questions(spark, SF001), corpus, Options(use_index=corpus is not None), gens), "run")
    rows = [r for r in run.collect() if r.calls]
    assert rows and all(r.answer.startswith(start) for r in rows)
    assert all((r.calls, r.retried) == ((2, True) if route == "strict" else (1, False)) for r in rows)


def test_second_pass_sees_broken_rows_alone(spark, tmp_path):
    def make(name, answers):
        def load(profile):
            def predict(prompts, seeds):
                import os

                with open(f"{tmp_path}/{name}-{os.getpid()}", "a") as f:
                    f.write("x" * len(prompts))
                return {"text": [answers(p) for p in prompts], "tokens": [3] * len(prompts)}

            return predict

        return load

    def calls(name):
        return sum(len(f.read_text()) for f in tmp_path.glob(f"{name}-*"))

    qs = spark.createDataFrame([(i, f"Как дела у соседа номер {i}, скажи") for i in range(40)] + [(100, "Сколько будет 2 плюс 3?")], "qid long, question string")
    gens = I.Generators(plain=make("first", lambda p: "слово" if "1" in p else "полный первый ответ"),
                        strict=make("second", lambda p: "полный второй ответ" if "2" not in p.split("[USER]")[-1] else "слово"))
    run = written(run_questions(qs, None, Options(use_index=False), gens), "run")
    rows = {r.qid: r for r in run.collect()}
    broken = [i for i in range(40) if "1" in str(i)]
    assert calls("first") == 40 and calls("second") == len(broken)
    assert rows[100].route == "math" and rows[100].calls == rows[100].tokens == 0
    for i in range(40):
        want = ("полный первый ответ", False, 1, 3) if i not in broken else (("Не знаю" if "2" in str(i) else "полный второй ответ"), True, 2, 6)
        assert (rows[i].answer, rows[i].retried, rows[i].calls, rows[i].tokens) == want
    s = run_summary(run).first()
    assert (s.n, s.retried, s.calls, s.tokens) == (41, len(broken), 40 + len(broken), 3 * (40 + len(broken))) and s.avg_tok_s > 0
    none = run_summary(run.limit(0)).first()
    assert (none.n, none.retried, none.calls, none.tokens, none.avg_tok_s, none.avg_time_s) == (0, 0, 0, 0, 0.0, 0.0)


# --- conversations -------------------------------------------------------------------

def conversation_rows():
    r = random.Random(8)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "  ", f"m{t}"])) for c in [*range(30), None] for t in range(r.randrange(1, 9))]
    rows += [(777, t, "user" if t % 2 else "assistant", f"hot {t}") for t in range(300)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("reset", [False, True])
def test_history(spark, monkeypatch, reset):
    monkeypatch.setattr(H, "BLOCK", 7)
    rows = conversation_rows()
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    flag = F.col("turn") % 50 == 49
    got = H.with_history(conv, flag if reset else None).collect()
    want, by = {}, defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        if reset and t % 50 == 49:
            by[c] = []
        by[c] = by[c] + [(role or "user", text or "")]
        want[c, t] = by[c]
    assert {(r.conv_id, r.turn): [tuple(m) for m in r.history] for r in got} == want and len(got) == len(rows)
    ranges = H.history_ranges(conv, flag if reset else None).collect()
    assert {(r.conv_id, r.turn): r.pos - r.first_pos + 1 for r in ranges} == {k: len(v) for k, v in want.items()}


def test_hot_conversation_spreads(spark):
    """A conversation with most of the rows is numbered in many tasks, none of which holds more than its share."""
    n = 8000
    rows = spark.range(n).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit(1).cast("long").alias("one"))
    rows = rows.unionByName(spark.range(400).select(F.col("id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.lit(1).cast("long").alias("one")))
    got = running_totals(rows, ["conv_id"], [F.col("turn")], {"pos": ("sum", "one")}, "spread", parts=8)
    found = {r.turn: r.pos for r in got.filter("conv_id = 5").collect()}
    assert found == {t: t + 2 for t in range(-1, n)}
    sizes = [r["count"] for r in got.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < n / 4


def test_running_totals(spark):
    r = random.Random(3)
    rows = [(r.randrange(-3, 3), r.randrange(4), i, r.randrange(-2**62, 2**62)) for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, b long, at long, v long")
    for parts in (1, 7, 40):
        got = running_totals(df.withColumn("one", F.lit(1).cast("long")), ["a", "b"], [F.col("at").desc()], {"n": ("sum", "one"), "x": ("xor", "v")}, parts=parts)
        n, x, want = defaultdict(int), defaultdict(int), {}
        for a, b, at, v in sorted(rows, key=lambda q: -q[2]):
            n[a, b] += 1
            x[a, b] ^= v
            want[at] = (n[a, b], x[a, b])
        assert {q["at"]: (q["n"], q["x"]) for q in got.collect()} == want
    assert running_totals(df.limit(0), ["a", "b"], [F.col("at")], {"n": ("sum", "v")}).count() == 0


# --- stream --------------------------------------------------------------------------

def test_stream_replays_an_epoch_once(spark, tmp_path):
    from lectern.plans.answer import build_corpus, open_corpus, store_corpus
    from lectern.streaming.questions import answer_stream

    docs = spark.createDataFrame([(1, "t", "Река Волга впадает в Каспийское море. Это длинная река."), (2, "t", "Кошка спит дома весь день и ночь.")], "doc_id long, title string, text string")
    store_corpus(build_corpus(docs), f"{tmp_path}/index")
    corpus = open_corpus(spark, f"{tmp_path}/index")

    def arrive(name, rows):
        spark.createDataFrame(rows, "qid long, question string").coalesce(1).write.mode("append").json(f"{tmp_path}/in/{name}")

    def answer():
        answer_stream(spark, f"{tmp_path}/in/*", corpus, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()

    arrive("a", [(1, "Куда впадает река Волга"), (2, "")])
    answer()
    arrive("b", [(3, "Сколько будет 2 плюс 2?")])
    answer()
    out = sorted((r.qid, r.epoch) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert out == [(1, 0), (3, 1)]
    (tmp_path / "ckpt" / "commits" / "1").unlink()  # as if the job had failed between the write and the commit
    crc = tmp_path / "ckpt" / "commits" / ".1.crc"
    if crc.exists():
        crc.unlink()
    answer()
    assert sorted((r.qid, r.epoch) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == out
