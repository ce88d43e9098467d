"""Text projections (survey §2.2) as built-in Column expressions.

Everything here compiles to JVM string/regex expressions, so it stays inside
whole-stage codegen.  Python string semantics are reproduced explicitly:
``str.strip``/``str.split``/``\\w``/``\\s`` are Unicode-aware in Python, while
Spark's ``trim`` removes only U+0020 and Java's ``\\s``/``\\w``/``\\d`` are ASCII.

Rules that chain several steps (``clean_answer``, ``is_broken``) are DataFrame
transforms that add one column per step, so Catalyst does not inline a large
expression several times (CollapseProject keeps repeated non-cheap aliases).
"""
from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------
REFUSE = "Не знаю"
REFUSAL_PHRASES = [
    "не знаю", "не могу ответить", "затрудняюсь", "нет данных",
    "i don't know", "i do not know", "unknown", "no idea", "cannot answer",
]
REFUSAL_PHRASES_BASIC = ["i don't know", "i do not know", "unknown", "cannot answer", "no idea"]
SHORT_OK = ["да", "нет", "да.", "нет."]
QUESTION_OK = ["да?", "нет?"]
BROKEN_SET = ["энергии?", "тяжести?", "?", "ла?", "формула воды?"]
TRANSLATE_TRIGGER = "переведи на английский"
ECHO_CHARS_RAW = " \\–—-:.,!?\"'\n\t"
ECHO_CHARS_POST = " \t\n\r-–—:.,!?\"'"
BASIC_PUNCT_CLASS = r"[,.;:!?()\[\]{}\-—–«»\"']"
CAP_WORDS = 14
CAP_WORDS_BASIC = 20
ROLE = "assistant"
# ---------------------------------------------------------------------------

# Python's whitespace set (str.isspace), derived by rule rather than listed.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# The same set as a regex class body; valid for both Java regex and RE2.
WS_BODY = r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\p{Z}"
WS = f"[{WS_BODY}]"
# Python's \w on str == letters, numbers and underscore.
WORD_BODY = r"\p{L}\p{N}_"
PUNCT_RUN = f"[^{WORD_BODY}{WS_BODY}]+"
WORD_RUN = f"[{WORD_BODY}]+"
# str.splitlines() boundaries.
LINE_BREAK = r"\r\n|[\n\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

_seq = itertools.count()


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def lstrip_chars(col, chars: str) -> Column:
    return F.ltrim(_c(col), F.lit(chars))


def normalize_text(col) -> Column:
    """B1: lower, punctuation runs -> space, whitespace runs -> one space, strip."""
    t = F.lower(F.coalesce(_c(col), F.lit("")))
    t = F.regexp_replace(t, PUNCT_RUN, " ")
    t = F.regexp_replace(t, f"{WS}+", " ")
    return F.trim(t)


def normalize_text_basic(col) -> Column:
    """B2: notebook variant, only a fixed punctuation list becomes space."""
    t = F.lower(strip(F.coalesce(_c(col), F.lit(""))))
    t = F.regexp_replace(t, BASIC_PUNCT_CLASS + "+", " ")
    t = F.regexp_replace(t, f"{WS}+", " ")
    return strip(t)


def tokens(col) -> Column:
    """Whitespace tokens of an already normalised string (no empty tokens)."""
    return F.array_remove(F.split(_c(col), " "), "")


def lemmatize_with_map(col, lemma_map: Column) -> Column:
    """B3 (small lemma table): map each token through a map column, unknown -> itself."""
    toks = F.split(_c(col), " ")
    return F.array_join(F.transform(toks, lambda t: F.coalesce(F.element_at(lemma_map, t), t)), " ")


def strip_echo(text, question, chars: str = ECHO_CHARS_POST) -> Column:
    """Cut a leading case-insensitive copy of the question, then left-trim ``chars``."""
    t = _c(text)
    q = strip(F.coalesce(_c(question), F.lit("")))
    hit = (F.length(q) > 0) & F.lower(t).startswith(F.lower(q))
    return F.when(hit, lstrip_chars(F.substr(t, F.length(q) + 1), chars)).otherwise(t)


def drop_role_lines(col) -> Column:
    """First stripped non-blank line that does not start with the role word."""
    lines = F.transform(F.split(_c(col), LINE_BREAK), lambda x: strip(x))
    lines = F.filter(lines, lambda x: (F.length(x) > 0) & ~F.lower(x).startswith(ROLE))
    return F.coalesce(F.get(lines, 0), F.lit(""))


def strip_role_suffix(col) -> Column:
    """Remove trailing ``assistant`` / ``assistant:`` repeatedly."""
    return F.regexp_replace(_c(col), f"(?i)(?:{WS}*{ROLE}:?)+{WS}*\\z", "")


def strip_role_prefix(col) -> Column:
    """Leading ``assistant`` -> drop 9 chars and strip ``: \\n`` at both ends."""
    t = _c(col)
    return F.when(F.lower(t).startswith(ROLE), F.btrim(F.substr(t, F.lit(10)), F.lit(": \n"))).otherwise(t)


def first_sentence(col, min_end: int = 0) -> Column:
    """Cut after the earliest ``.``/``!``/``?``; strip only when cut."""
    t = _c(col)
    head = F.regexp_extract(t, r"\A[^.!?]*[.!?]", 0)
    cut = (F.length(head) > 0) & (F.length(head) < F.length(t))
    if min_end:
        cut = cut & (F.length(head) >= min_end)
    return F.when(cut, strip(head)).otherwise(t)


def is_refusal(col, phrases=REFUSAL_PHRASES) -> Column:
    low = F.lower(_c(col))
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


def letter_count(col) -> Column:
    return F.length(F.regexp_replace(_c(col), r"\P{L}", ""))


def ends_with_ne(low) -> Column:
    return _c(low).rlike(f"(?:\\A|{WS})не\\.?\\z")


def is_fragment(col) -> Column:
    """B13 on an already-stripped text."""
    t = _c(col)
    low = F.lower(t)
    q_end = t.endswith("?") & ~low.isin(*QUESTION_OK)
    short = (letter_count(t) <= 2) & ~low.isin(*SHORT_OK)
    return q_end | ends_with_ne(low) | short


def word_count(col) -> Column:
    return F.size(F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_RUN), 0))


def is_broken(col) -> Column:
    """The answer looks broken (blank, question, dangling negation, too short)."""
    raw = F.coalesce(_c(col), F.lit(""))
    t = strip(raw)
    low = F.lower(t)
    blank = F.length(t) == 0
    numeric = t.rlike(r"\A\p{Nd}+[.,]?\p{Nd}*\z")
    return (
        blank
        | t.endswith("?")
        | ends_with_ne(low)
        | (F.length(t) <= 2)
        | (letter_count(t) <= 2)
        | ((word_count(t) <= 1) & ~numeric)
        | low.isin(*BROKEN_SET)
    )


def extract_translation(col) -> Column:
    """First Latin run of the answer with quotes removed, or REFUSE."""
    t = strip(F.translate(_c(col), "\"'«»", ""))
    m = F.regexp_extract(t, r"[A-Za-z][A-Za-z .,!?'\-]*", 0)
    eng = F.btrim(strip(m), F.lit(" ."))
    return F.when(F.length(eng) > 0, eng).otherwise(F.lit(REFUSE))


def wants_translation(question) -> Column:
    return F.coalesce(F.lower(_c(question)).contains(TRANSLATE_TRIGGER), F.lit(False))


def cap_words(col, n: int = CAP_WORDS) -> Column:
    """More than ``n`` words -> first ``n`` joined by one space, rtrim ``,;:``, end with ``.``."""
    t = _c(col)
    words = F.split(strip(t), f"{WS}+")
    capped = F.rtrim(F.array_join(F.slice(words, 1, n), " "), F.lit(",;:"))
    capped = F.when(capped.endswith("."), capped).otherwise(F.concat(capped, F.lit(".")))
    return F.when(F.size(words) > n, capped).otherwise(t)


def ellipsize(col, n: int = 120) -> Column:
    """Keep up to ``n`` chars, else first ``n-3`` plus ``...``."""
    t = _c(col)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 3), F.lit("...")))


def _tmp() -> str:
    return f"__lt{next(_seq)}"


def clean_answer(df: DataFrame, raw: str, question: str | None, out: str) -> DataFrame:
    """Engine answer cleanup as a chain of projections."""
    t0, t1, t2, res = _tmp(), _tmp(), _tmp(), _tmp()
    df = df.withColumn(t0, strip(F.coalesce(F.col(raw), F.lit(""))))
    qcol = F.col(question) if question else F.lit(None).cast("string")
    df = df.withColumn(t1, strip_echo(F.col(t0), qcol, ECHO_CHARS_POST))
    df = df.withColumn(t2, first_sentence(F.col(t1)))
    t = F.col(t2)
    translated = extract_translation(t)
    result = (
        F.when(F.length(F.col(t0)) == 0, F.lit(REFUSE))
        .when(is_refusal(t), F.lit(REFUSE))
        .when(is_fragment(t), F.lit(REFUSE))
        .when(wants_translation(qcol), translated)
        .otherwise(cap_words(t, CAP_WORDS))
    )
    df = df.withColumn(res, result)
    df = df.withColumn(out, F.when(F.length(F.col(res)) == 0, F.lit(REFUSE)).otherwise(F.col(res)))
    return df.drop(t0, t1, t2, res)


def clean_answer_basic(df: DataFrame, raw: str, question: str | None, out: str) -> DataFrame:
    """Notebook cleanup (no echo strip, English refusals, 20-word cap)."""
    t0, t1, res = _tmp(), _tmp(), _tmp()
    df = df.withColumn(t0, strip(F.coalesce(F.col(raw), F.lit(""))))
    df = df.withColumn(t1, first_sentence(F.col(t0), min_end=5))
    t = F.col(t1)
    qcol = F.col(question) if question else F.lit(None).cast("string")
    result = (
        F.when(F.length(F.col(t0)) == 0, F.lit(REFUSE))
        .when(is_refusal(t, REFUSAL_PHRASES_BASIC), F.lit(REFUSE))
        .when(wants_translation(qcol), extract_translation(t))
        .otherwise(cap_words(t, CAP_WORDS_BASIC))
    )
    df = df.withColumn(res, result)
    df = df.withColumn(out, F.when(F.length(F.col(res)) == 0, F.lit(REFUSE)).otherwise(F.col(res)))
    return df.drop(t0, t1, res)


def clean_raw_output(df: DataFrame, raw: str, question: str | None, out: str) -> DataFrame:
    """I4: plain-route raw cleanup = echo strip (raw set) -> first non-role line -> role suffix."""
    t0, t1 = _tmp(), _tmp()
    df = df.withColumn(t0, strip(F.coalesce(F.col(raw), F.lit(""))))
    qcol = F.col(question) if question else F.lit(None).cast("string")
    df = df.withColumn(t1, drop_role_lines(strip_echo(F.col(t0), qcol, ECHO_CHARS_RAW)))
    df = df.withColumn(out, strip_role_suffix(F.col(t1)))
    return df.drop(t0, t1)
