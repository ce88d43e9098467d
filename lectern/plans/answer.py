"""End-to-end plans: corpus build (L1) and question answering (L2, flagship I5).

``answer_questions`` splits the questions by route with filters, so each
branch only carries the rows it must: rule answers never reach retrieval, and
rejected questions never reach the generator.

Corpus side at scale: chunk rows are hash-clustered by ``(doc_id, pos)`` once;
term counts, vector norms, score sums and the partial top-k all run on that
layout.  The top-k table is written once, so scoring runs once however many
steps read it, and texts are fetched for its keys only.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arithmetic import with_math_answer
from ..functions.text import REFUSE, clean_answer, clean_raw_output, is_broken, strip
from ..functions import prompts as P
from ..operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_documents, cluster_chunks, cluster_parts, prepare_documents
from ..operators.context import MAX_CTX_CHARS, build_context, fetch_chunks
from ..operators.inference import PROFILE_CONTEXT, PROFILE_PLAIN, RAW, Generators, encode_batch, extractive_answer, generate_batch
from ..operators.lemmas import Lemmas
from ..operators.routing import THRESHOLD, gate, merge_answers
from ..operators.term_blocks import block_top_k, passes, question_blocks, term_blocks
from ..operators.vectors import TOP_K, BLOCK_SCHEMA, dense_top_k_of_blocks, encode_terms, l2_normalize, normalize_lemma, rank_top_k, vector_blocks, vector_rows
from ..session import LARGE_ROWS, written
from ..sources.chunk_store import ChunkStore, write_chunk_store
from ..sources.sinks import META_SCHEMA, index_meta, read_vector_store, write_vector_store


@dataclass(frozen=True)
class Options:
    """Run options (the reference's three config sections, flattened)."""

    top_k: int = TOP_K
    threshold: float = THRESHOLD
    max_ctx_chars: int = MAX_CTX_CHARS
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    use_index: bool = True


@dataclass
class Corpus:
    """Chunks ``(doc_id, pos, title, text)`` and what is scored.

    Default encoder: unit vectors ``(doc_id, pos, term, w)``, made when they are asked for, and term blocks.
    User encoder: vector blocks of the numbered chunks of ``store``.
    ``lemmas``: the memo that corpus and questions share, if any.
    """

    chunks: DataFrame
    encode: Callable[[], DataFrame] | None = None
    blocks: DataFrame | None = None
    lemmas: Lemmas | None = None
    store: ChunkStore | None = None
    dense: DataFrame | None = None
    make_encoder: Callable[[], Callable] | None = None

    @cached_property
    def vectors(self) -> DataFrame | None:
        """The unit vectors; nothing is counted or joined for them where only the blocks are asked."""
        return self.encode() if self.encode is not None else None


def build_corpus(docs: DataFrame, opts: Options = Options(), lemma_map: Column | None = None, lemmas: Lemmas | None = None) -> Corpus:
    """L1: documents ``(doc_id, title, text)`` -> chunks, unit term vectors and term blocks (lazy; blocks are written with ``lemmas``)."""
    chunks = chunk_documents(docs, opts.chunk_size, opts.chunk_overlap)
    blocks = term_blocks(chunks, "doc_id", "pos", "text", lemma_map)
    blocks = lemmas.of_blocks(blocks) if lemmas is not None else blocks

    def encode() -> DataFrame:
        memo = lemmas.memo(docs.sparkSession) if lemmas is not None else None
        return encode_terms(cluster_chunks(chunks, cluster_parts(docs)), ["doc_id", "pos"], "text", lemma_map, memo)

    return Corpus(chunks, encode, blocks, lemmas)


def store_corpus(corpus: Corpus, path: str, opts: Options = Options()) -> None:
    """Write chunks, vectors, term blocks and the index meta (A14-A16) under one folder."""
    write_chunk_store(corpus.chunks, f"{path}/chunks")
    write_vector_store(corpus.vectors, f"{path}/vectors")
    corpus.blocks.write.mode("overwrite").options(**LARGE_ROWS).parquet(f"{path}/blocks")
    index_meta(corpus.chunks, corpus.vectors, "terms", opts.chunk_size, opts.chunk_overlap).write.mode("overwrite").json(f"{path}/meta")


def store_dense_corpus(docs: DataFrame, path: str, make_encoder: Callable[[], Callable], model: str, opts: Options = Options(),
                       lemmas: Lemmas | None = None) -> None:
    """L1 with a user encoder: the chunk store, the exact flat index of its numbered chunks as vector blocks, and the meta."""
    spark = docs.sparkSession
    write_chunk_store(chunk_documents(docs, opts.chunk_size, opts.chunk_overlap), f"{path}/chunks")
    chunks = ChunkStore(spark, f"{path}/chunks").numbered().select("chunk_id", "text")
    vectors = encode_batch(_normalised(chunks, "chunk_id", "text", lemmas), "norm", make_encoder)
    held = vector_blocks(vector_rows(vectors.withColumn("embedding", l2_normalize("embedding")), "chunk_id", "embedding"), f"{path}/dense")
    dims = held.agg(F.max("dims").cast("long").alias("dim"), F.sum(F.octet_length("ids") / 8).cast("long").alias("chunks"))
    dims.select(F.lit(model).alias("model"), "dim", "chunks", F.lit(opts.chunk_size).alias("chunk_size"),
                F.lit(opts.chunk_overlap).alias("chunk_overlap")).write.mode("overwrite").json(f"{path}/meta")


def _normalised(df: DataFrame, key: str, text: str, lemmas: Lemmas | None) -> DataFrame:
    """(key, norm): what an encoder sees."""
    return df.select(key, normalize_lemma(text).alias("norm")) if lemmas is None else lemmas.of_texts(df, [key], text)


def _check_meta(spark: SparkSession, path: str, opts: Options) -> None:
    meta = spark.read.schema(META_SCHEMA).json(f"{path}/meta").first()
    if meta is None or (meta["chunk_size"], meta["chunk_overlap"]) != (opts.chunk_size, opts.chunk_overlap):
        raise ValueError(f"the index at {path} was built with other chunk settings: {meta}")


def open_corpus(spark: SparkSession, path: str, opts: Options = Options(), lemmas: Lemmas | None = None) -> Corpus:
    """Answer from a stored index: chunks, vectors and blocks are read, nothing is chunked or encoded again.

    ``lemmas``: the memo that the index was built with, for the questions.
    """
    _check_meta(spark, path, opts)
    store = ChunkStore(spark, f"{path}/chunks")
    return Corpus(store.rows(), lambda: read_vector_store(spark, f"{path}/vectors"), spark.read.parquet(f"{path}/blocks"), lemmas, store)


def open_dense_corpus(spark: SparkSession, path: str, make_encoder: Callable[[], Callable], opts: Options = Options(),
                      lemmas: Lemmas | None = None) -> Corpus:
    """A stored dense index; ``make_encoder`` encodes the questions."""
    _check_meta(spark, path, opts)
    store = ChunkStore(spark, f"{path}/chunks")
    return Corpus(store.rows(), lemmas=lemmas, store=store, dense=spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/dense"), make_encoder=make_encoder)


def load_corpus_from_documents(spark: SparkSession, sf_dir: str, opts: Options = Options()) -> Corpus:
    docs = prepare_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "source", "doc_id")
    return build_corpus(docs, opts)


def load_benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions ``(qid, question)``: stripped, blank dropped."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(F.col("item_id").cast("long").alias("qid"), strip(F.coalesce("text", F.lit(""))).alias("question")).filter(
        F.length("question") > 0
    )


def top_chunks(questions: DataFrame, corpus: Corpus, k: int = TOP_K, lemma_map: Column | None = None) -> DataFrame:
    """F2 + F4 + F5: ``(qid, question)`` -> ``(qid, doc_id, pos, score, rank)``; equal questions are scored once."""
    rows = questions.filter("qid is not null").select(F.col("qid").cast("bigint").alias("qid"), F.coalesce("question", F.lit("")).alias("question"))
    texts = written(rows.select("question").distinct().withColumn("text_id", F.monotonically_increasing_id()), "question-texts")
    asked = question_blocks(texts, "text_id", "question", lemma_map)
    asked = corpus.lemmas.of_blocks(asked) if corpus.lemmas is not None else asked
    asked, held = written(asked, "question-blocks", **LARGE_ROWS), corpus.blocks
    if corpus.store is None and passes(asked) > 1:  # or every pass would cut and count the corpus again
        held = written(held, "corpus-blocks", **LARGE_ROWS)
    found = block_top_k(asked, held, k, "text_id")
    found = written(found.drop("rank"), "text-top-k")
    return rank_top_k(rows.join(texts, "question").join(found, "text_id").select("qid", "doc_id", "pos", "score"), ["qid"], ["doc_id", "pos"], k)


def top_chunk_ids(questions: DataFrame, corpus: Corpus, k: int = TOP_K) -> DataFrame:
    """F2 + F3 + F5: ``(qid, question)`` -> ``(qid, chunk_id, score, rank)`` by the stored vectors of a user encoder."""
    norm = _normalised(questions.filter("qid is not null"), "qid", "question", corpus.lemmas)
    vectors = encode_batch(norm, "norm", corpus.make_encoder)
    return dense_top_k_of_blocks(vector_rows(vectors.withColumn("embedding", l2_normalize("embedding")), "qid", "embedding"), corpus.dense, k, "chunk_id")


def retrieve(questions: DataFrame, corpus: Corpus, opts: Options = Options(),
             lemma_map: Column | None = None) -> DataFrame:
    """``(qid, question)`` -> ``(qid, best_score, scores, ids, ctx)`` for questions with any score."""
    if corpus.dense is not None:
        fetched = corpus.store.fetch(written(top_chunk_ids(questions, corpus, opts.top_k), "top-k"), by="id")
    else:
        top = written(top_chunks(questions, corpus, opts.top_k, lemma_map), "top-k")
        fetched = corpus.store.fetch(top) if corpus.store is not None else fetch_chunks(top, corpus.chunks)
    return build_context(fetched, ["qid"], opts.top_k, opts.max_ctx_chars)


def _finish_context(df: DataFrame, raw: str) -> DataFrame:
    df = clean_answer(df, raw, "question", "cleaned")
    return df.withColumn("answer", F.when(is_broken("cleaned"), F.lit(REFUSE)).otherwise(F.col("cleaned")))


def _generated(df: DataFrame, prompt: Column, make_generator, profile, batch_size: int) -> DataFrame:
    """``df`` with ``gen``: the model's text, tokens and seconds; without a model nothing was said and no call made."""
    if make_generator is None:
        return df.withColumn("gen", F.lit(None).cast(RAW))
    return generate_batch(df.withColumn("__p", P.render_flat(prompt)), "__p", make_generator, profile, "gen", batch_size).drop("__p")


def _cost(calls: int, *passes: str) -> list[Column]:
    """(calls, tokens, seconds) of the passes of a row (J2: both passes summed)."""
    tokens = sum((F.coalesce(F.col(f"{p}.tokens"), F.lit(0)) for p in passes), F.lit(0).cast("bigint"))
    seconds = sum((F.coalesce(F.col(f"{p}.seconds"), F.lit(0.0)) for p in passes), F.lit(0.0))
    return [F.lit(calls).cast("bigint").alias("calls"), tokens.alias("tokens"), seconds.alias("seconds")]


def _plain_branch(rest: DataFrame, gens: Generators) -> DataFrame:
    """No index: plain generation, cleanup, strict retry on broken answers.

    Each pass is written once: a model never runs twice for a row, and the second sees the broken rows alone.
    """
    first = _generated(rest, P.prompt_plain("question"), gens.plain, PROFILE_PLAIN, gens.batch_size).withColumn("raw", F.col("gen.text"))
    first = clean_raw_output(first, "raw", "question", "raw1")
    first = clean_answer(first, "raw1", "question", "ans1").withColumn("bad", is_broken("ans1"))
    first = written(first.select("qid", "question", "gen", "ans1", "bad"), "first-pass")
    n = int(gens.plain is not None)
    good = first.filter(~F.col("bad")).select("qid", F.col("ans1").alias("answer"), F.lit(False).alias("retried"), *_cost(n, "gen"))
    again = first.filter("bad").select("qid", "question", F.col("gen").alias("gen1"))
    again = _generated(again, P.prompt_strict("question"), gens.strict, PROFILE_PLAIN, gens.batch_size).withColumn("raw", F.col("gen.text"))
    again = clean_raw_output(again, "raw", "question", "raw2")
    again = clean_answer(again, "raw2", "question", "ans2").withColumn("bad2", is_broken("ans2"))
    again = again.select("qid", F.when(F.col("bad2"), F.lit(REFUSE)).otherwise(F.col("ans2")).alias("answer"), F.lit(True).alias("retried"),
                         *_cost(n + int(gens.strict is not None), "gen1", "gen"))
    return good.unionByName(again).withColumn("route", F.lit("plain")).withColumn("best_score", F.lit(None).cast("double"))


def run_questions(questions: DataFrame, corpus: Corpus | None, opts: Options = Options(),
                  gens: Generators | None = None, lemma_map: Column | None = None) -> DataFrame:
    """I5 as a run: ``(qid, question, answer, route, best_score, retried, calls, tokens, seconds)``.

    ``calls``: how often a user model was asked for the row; its tokens and seconds are summed over both passes.
    """
    gens = gens or Generators()
    # Route once: the question table is the small side; writing it to the shared
    # checkpoint folder fixes the split and keeps the rule expressions out of
    # every downstream plan.
    q = with_math_answer(questions.select("qid", "question"), "question", "math").checkpoint(eager=True)
    none = [F.lit(False).alias("retried"), *_cost(0)]
    math_rows = q.filter(F.col("math").isNotNull()).select(
        "qid", F.col("math").alias("answer"), F.lit("math").alias("route"), F.lit(None).cast("double").alias("best_score"), *none
    )
    rest = q.filter(F.col("math").isNull()).select("qid", "question")
    if corpus is None or not opts.use_index:
        branches = [math_rows, _plain_branch(rest, gens)]
    else:
        retr = retrieve(rest, corpus, opts, lemma_map)
        # one row per question; both gate branches read the written result
        judged = rest.join(retr, "qid", "left").withColumn("ok", gate("best_score", "ctx", opts.threshold))
        judged = judged.checkpoint(eager=True)
        rejected = judged.filter(~F.col("ok")).select(
            "qid", F.lit(REFUSE).alias("answer"), F.lit("refused").alias("route"), "best_score", *none
        )
        accepted = judged.filter(F.col("ok"))
        if gens.context is None:
            gen = accepted.withColumn("raw", extractive_answer(F.col("question"), F.col("ctx"))).withColumn("gen", F.lit(None).cast(RAW))
        else:
            gen = _generated(accepted, P.prompt_context("question", "ctx"), gens.context, PROFILE_CONTEXT, gens.batch_size)
            gen = gen.withColumn("raw", F.col("gen.text"))
        ctx_rows = _finish_context(gen, "raw").select(
            "qid", "answer", F.lit("context").alias("route"), "best_score", F.lit(False).alias("retried"),
            *_cost(int(gens.context is not None), "gen")
        )
        branches = [math_rows, rejected, ctx_rows]
    out = merge_answers(q.select("qid", "question"), branches)
    return out.select("qid", "question", "answer", F.coalesce("route", F.lit("refused")).alias("route"),
                      F.round("best_score", 6).alias("best_score"), F.coalesce("retried", F.lit(False)).alias("retried"),
                      *(F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "tokens")), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))


def answer_questions(questions: DataFrame, corpus: Corpus | None, opts: Options = Options(),
                     gens: Generators | None = None, lemma_map: Column | None = None) -> DataFrame:
    """I5 (flagship): ``(qid, question)`` -> ``(qid, question, answer, route, best_score)``."""
    return run_questions(questions, corpus, opts, gens, lemma_map).select("qid", "question", "answer", "route", "best_score")


def run_summary(run: DataFrame) -> DataFrame:
    """J1-J3 of a written run: one row with mean rate, mean time, counts and sums (0.0 when empty)."""
    rate = F.when(F.col("seconds") <= 1e-6, F.lit(0.0)).otherwise(F.col("tokens") / F.col("seconds"))
    zero = F.lit(0.0)
    return run.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("retried")).alias("retried"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
                   F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.avg(F.round(rate, 2)), zero), 2).alias("avg_tok_s"),
                   F.round(F.coalesce(F.avg(F.round("seconds", 3)), zero), 2).alias("avg_time_s"))
