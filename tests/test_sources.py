"""Files: nothing is lost silently, blanks survive, positions run across files, duplicates are seen."""
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lectern import session
from lectern.operators import vectors as V
from lectern.sources import readers as RD
from lectern.sources import sinks as SK


def test_json_documents_fail_loudly(spark, tmp_path):
    for name, body in (("bad.json", '{"items": [{"text": "a"'), ("other.json", '{"rows": []}')):
        (tmp_path / name).write_text(body)
        with pytest.raises(PySparkException):
            RD.read_documents(spark, str(tmp_path / name)).collect()


def test_jsonl_documents_fail_loudly(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "one"}\nnot json\n')
    with pytest.raises(PySparkException):
        RD.read_documents(spark, str(tmp_path / "x.jsonl")).collect()


def test_json_positions_run_across_files(spark, tmp_path):
    for name, items in (("a.json", ["q0", "q1"]), ("b.json", ["q2", {"question": "q3"}])):
        (tmp_path / name).write_text(json.dumps({"questions": items}))
    got = {r.qid: r.question for r in RD.read_questions(spark, str(tmp_path), "json").collect()}
    assert got == {0: "q0", 1: "q1", 2: "q2", 3: "q3"}


def test_suffix_chooses_the_format(spark, tmp_path):
    (tmp_path / "d.txt").write_text("﻿whole\nfile ")
    (tmp_path / "d.csv").write_text('title,text\nT,"a, b"\n')
    (tmp_path / "d.tsv").write_text("body\tx\none\ttwo\n")
    (tmp_path / "d.jsonl").write_text('{"title": "T", "text": " t "}\n\n{"text": ""}\n')
    read = lambda n: [(r.title, r.text) for r in RD.read_documents(spark, str(tmp_path / n)).collect()]
    assert read("d.txt") == [("", "whole\nfile")]
    assert read("d.csv") == [("T", "a, b")]
    assert read("d.tsv") == [("", "one")]
    assert read("d.jsonl") == [("T", "t")]


@pytest.mark.parametrize("fmt", ["csv", "tsv"])
def test_blanks_survive_in_delimited_files(spark, tmp_path, fmt):
    rows = [(0, "  lead", "tail  "), (1, "a\nb", 'q"q')]
    SK.write_answers(spark.createDataFrame(rows, "qid long, question string, answer string"), str(tmp_path / fmt), fmt)
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .option("sep", "," if fmt == "csv" else "\t").csv(str(tmp_path / fmt)))
    assert sorted(tuple(r) for r in back.collect()) == sorted((q, a) for _, q, a in rows)


def test_alignment_counts_rows_per_key(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    assert SK.check_alignment(q, q).first()["pairs"] == 2
    twice = spark.createDataFrame([(1,), (1,), (2,)], "qid long")
    with pytest.raises(PySparkException):
        SK.check_alignment(q, twice).collect()


def test_shared_folder_is_required_off_local_mode(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_unit_norm_and_zero_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r.u for r in df.select(V.l2_normalize("v").alias("u")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_answers_from_a_stored_index(spark, tmp_path):
    from conftest import SF001

    from lectern.plans.answer import (Options, answer_questions, load_benchmark_questions, load_corpus_from_documents,
                                      open_corpus, store_corpus)

    corpus = load_corpus_from_documents(spark, SF001)
    store_corpus(corpus, str(tmp_path / "index"))
    qs = load_benchmark_questions(spark, SF001)
    stored = open_corpus(spark, str(tmp_path / "index"))
    rows = lambda c: sorted(tuple(r) for r in answer_questions(qs, c).collect())
    assert rows(stored) == rows(corpus)
    with pytest.raises(ValueError):
        open_corpus(spark, str(tmp_path / "index"), Options(chunk_size=300))


def test_retrieve_scores_once(spark):
    from conftest import SF001

    from lectern.plans.answer import load_benchmark_questions, load_corpus_from_documents, retrieve

    found = retrieve(load_benchmark_questions(spark, SF001), load_corpus_from_documents(spark, SF001))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan  # the top-k table is read, not computed again
    assert found.select(F.count("*")).first()[0] > 0


@pytest.mark.parametrize("rows", [0, 1, 60])
def test_json_document_in_parts(spark, tmp_path, rows):
    """The files of the manifest, one behind the other, are the document; the readers find the same elements."""
    from lectern.sources.json_document import manifest

    data = [(i * 7 % 61, f'a "{i}"\n\\ é🙂 ,', None if i % 5 == 0 else f", title {i}") for i in range(rows)]
    df = spark.createDataFrame(data, "qid long, answer string, title string").repartition(4)

    def whole(path):
        files = sorted(manifest(spark, path).collect())
        assert [f.ordinal for f in files] == list(range(len(files)))
        bodies = [(tmp_path / path / f.file).read_bytes() for f in files]
        assert [len(b) for b in bodies] == [f.bytes for f in files]
        return json.loads(b"".join(bodies))

    SK.write_answers_document(df, str(tmp_path / "answers"))
    want = [a for _, a, _ in sorted(data)]
    assert whole(str(tmp_path / "answers")) == want
    got = RD.read_questions(spark, str(tmp_path / "answers"), "json_parts").collect()
    assert {r.qid: r.question for r in got} == {i: a.strip() for i, a in enumerate(want)}
    SK.write_dataset_document(df.withColumnRenamed("answer", "text"), str(tmp_path / "items"), "qid")
    assert whole(str(tmp_path / "items")) == {"items": [{"text": a, "title": t or ""} for _, a, t in sorted(data)]}
    docs = RD.read_documents(spark, str(tmp_path / "items"), "json_parts").collect()
    assert {r.doc_id: (r.title, r.text) for r in docs} == {i: ((t or "").strip(), a.strip()) for i, (_, a, t) in enumerate(sorted(data))}
    SK.write_answers_document(df.withColumn("question", F.col("title")), str(tmp_path / "pairs"), pairs=True)
    assert whole(str(tmp_path / "pairs")) == [{"question": t or "", "answer": a} for _, a, t in sorted(data)]
