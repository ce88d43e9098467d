"""Answer generation (survey I1-I3).

* ``extractive_answer`` (I3) is the default generator when no model is given:
  the context sentence sharing the most distinct normalised terms with the
  question, earliest on ties.  It is a declared, deterministic stand-in for a
  language model and runs as built-in Column expressions.
* ``generate_batch`` (I1) runs a user-supplied model as Arrow-batched
  inference through ``predict_batch_udf``: the model is loaded once per Python
  worker by ``make_generator(profile)`` and sees fixed-size batches of prompts,
  each with a seed of its own.  Every row gets its text, tokens and seconds.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_text, strip, tokens

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------
GEN_BATCH = 8
ENCODE_BATCH = 64
SEED = 127


@dataclass(frozen=True)
class Profile:
    """Generation settings that ``make_generator`` gets; ``seed`` enters every row's seed."""

    max_new_tokens: int
    do_sample: bool
    temperature: float | None = None
    top_p: float | None = None
    repetition_penalty: float | None = None
    seed: int = SEED


PROFILE_CONTEXT = Profile(64, True, temperature=0.7, top_p=0.9)
PROFILE_PLAIN = Profile(48, False)
PROFILE_CODE = Profile(2048, False, repetition_penalty=1.1)
# ---------------------------------------------------------------------------

SENTENCE = r"([^.!?\n]+[.!?]?)"


def _terms(col) -> Column:
    return F.array_distinct(tokens(normalize_text(col)))


def extractive_answer(question, ctx) -> Column:
    """Best-overlap context sentence (earliest on ties), '' when there is none."""
    sentences = F.filter(
        F.transform(F.regexp_extract_all(F.coalesce(ctx, F.lit("")), F.lit(SENTENCE), 1), lambda s: strip(s)),
        lambda s: F.length(s) > 0,
    )
    # the question's terms are bound once as the single element of an array, not made again for every sentence
    best = F.transform(F.array(_terms(question)), lambda q_terms: F.array_min(F.transform(
        sentences,
        lambda s, i: F.struct((-F.size(F.array_intersect(_terms(s), q_terms))).alias("neg"), i.alias("idx"), s.alias("text")))))
    return F.coalesce(F.get(best, 0)["text"], F.lit(""))


RAW = "struct<text: string, tokens: bigint, seconds: double>"


def row_seed(prompt, seed: int = SEED) -> Column:
    """A row's seed: 60 bits that depend on the run's seed and the prompt, so partitions and batches don't change a sample."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(p, F.lit("")))), 1, 15), 16, 10).cast("bigint")


def generate_batch(df: DataFrame, prompt_col: str, make_generator: Callable, profile: Profile = PROFILE_PLAIN, out: str = "raw",
                   batch_size: int = GEN_BATCH) -> DataFrame:
    """I1 + I2: ``df`` with ``out``: a struct of text, tokens and seconds.

    ``make_generator(profile)`` is called once per Python worker (model load)
    and returns ``predict(prompts, seeds)`` over numpy arrays.  It gives the
    texts, or a dict of ``text`` and ``tokens`` (new tokens of each row; without
    it white-space words are counted).  A batch's time is shared by its rows.
    """
    from pyspark.ml.functions import predict_batch_udf

    def make():
        import time

        import numpy as np

        model = make_generator(profile)

        def predict(prompts, seeds):
            start = time.perf_counter()
            found = model(prompts, seeds)
            each = (time.perf_counter() - start) / max(1, len(prompts))
            texts = found["text"] if isinstance(found, dict) else found
            tokens = found["tokens"] if isinstance(found, dict) and "tokens" in found else [len(str(t).split()) for t in texts]
            return {"text": np.array(texts, dtype=object), "tokens": np.array(tokens, dtype=np.int64), "seconds": np.full(len(prompts), each)}

        return predict

    udf = predict_batch_udf(make, return_type=T.StructType([
        T.StructField("text", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("seconds", T.DoubleType())]), batch_size=batch_size)
    return df.withColumn(out, udf(F.coalesce(F.col(prompt_col), F.lit("")), row_seed(prompt_col, profile.seed)))


def encode_batch(df: DataFrame, text_col: str, make_encoder: Callable[[], Callable], out: str = "embedding",
                 batch_size: int = ENCODE_BATCH) -> DataFrame:
    """F2 with a user encoder: ``make_encoder()(texts: np.ndarray[str]) -> np.ndarray[n, dim]`` over fixed-size batches."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return df.withColumn(out, udf(F.col(text_col)))


@dataclass
class Generators:
    """User model hooks per route, each ``make_generator(profile)``; ``None`` means the deterministic default.

    ``context`` gets PROFILE_CONTEXT, ``plain`` and ``strict`` PROFILE_PLAIN, ``code`` PROFILE_CODE.
    """

    context: Callable | None = None
    plain: Callable | None = None
    strict: Callable | None = None
    code: Callable | None = None
    batch_size: int = GEN_BATCH
