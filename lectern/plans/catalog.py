"""Registered queries: one Spark job per operator of the survey inventory.

Every query reads the driver tables (or data Spark derives from them) over
whole tables and whole texts.  ``SQL`` holds the independent DuckDB statement
for the correctness gate, keyed like ``QUERIES``.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import oracle as O
from .answer import answer_questions, load_benchmark_questions, load_corpus_from_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("answer_questions", O.flagship())
def q_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I5 flagship: benchmark questions answered over the documents corpus."""
    corpus = load_corpus_from_documents(spark, sf_dir)
    return answer_questions(load_benchmark_questions(spark, sf_dir), corpus)


# ---------------------------------------------------------------------------
# Shared derivations (Spark side).  Each has the same derivation in SQL below.
# ---------------------------------------------------------------------------
from pyspark.sql import functions as F  # noqa: E402

from ..functions import arithmetic as A  # noqa: E402
from ..functions import prompts as P  # noqa: E402
from ..functions import text as T  # noqa: E402
from ..operators import chunking as CH  # noqa: E402
from ..operators import context as CX  # noqa: E402
from ..operators import routing as R  # noqa: E402
from ..operators import term_blocks as TB  # noqa: E402
from ..operators import token_blocks as TK  # noqa: E402
from ..operators import vectors as V  # noqa: E402
from ..operators.inference import extractive_answer  # noqa: E402
from ..session import written  # noqa: E402
from .answer import Options, build_corpus, retrieve, top_chunks  # noqa: E402


def docs_raw(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "text")


def prepared_docs(spark, sf):
    return CH.prepare_documents(table(spark, sf, "documents"), "text", "source", "doc_id")


# --- B: text projections over whole documents --------------------------------

DOC_TEXT = "coalesce(text, '')"


@register("normalize_text", f"SELECT doc_id, {O.norm('text')} AS norm FROM documents")
def q_normalize_text(spark, sf):
    return docs_raw(spark, sf).select("doc_id", T.normalize_text("text").alias("norm"))


@register("normalize_text_basic", f"SELECT doc_id, {O.norm_basic('text')} AS norm FROM documents")
def q_normalize_text_basic(spark, sf):
    return docs_raw(spark, sf).select("doc_id", T.normalize_text_basic("text").alias("norm"))


@register("normalize_lemma", f"SELECT doc_id, {O.norm('text')} AS norm FROM documents")
def q_normalize_lemma(spark, sf):
    """B5 with no lemma table: the normalised text."""
    return docs_raw(spark, sf).select("doc_id", V.normalize_lemma("text").alias("norm"))


LEMMA_RULE_SQL = (
    "WITH toks AS (SELECT doc_id, unnest(" + O.tokens(O.norm("text")) + ") AS tk, "
    "unnest(range(1, len(" + O.tokens(O.norm("text")) + ") + 1)) AS i FROM documents), "
    "lem AS (SELECT DISTINCT tk AS form, substring(tk, 1, 6) AS lemma FROM toks WHERE length(tk) >= 8) "
    "SELECT t.doc_id, string_agg(coalesce(l.lemma, t.tk), ' ' ORDER BY t.i) AS lemmatized "
    "FROM toks t LEFT JOIN lem l ON t.tk = l.form GROUP BY t.doc_id "
    "UNION ALL SELECT doc_id, '' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM toks)"
)


def lemma_table_from(tokens_df):
    """A lemma table derived from the corpus itself: forms of 8+ chars map to their first 6 chars."""
    return tokens_df.select(F.col("tk").alias("form")).filter(F.length("form") >= 8).distinct().select(
        "form", F.substring("form", 1, 6).alias("lemma")
    )


@register("lemmatize", LEMMA_RULE_SQL)
def q_lemmatize(spark, sf):
    """B3 large-table form: the distinct tokens of blocks of documents meet the lemma table, the texts are put together again."""
    blocks = TK.token_blocks(docs_raw(spark, sf).select("doc_id", T.tokens(T.normalize_text("text")).alias("forms")), ["doc_id"], "forms")
    lem = lemma_table_from(TK.block_forms(blocks).select(F.col("form").alias("tk")))
    # rows of one doc_id become one text, token by token; a single row stays as it is
    grouped = TK.replaced(blocks, lem, "lms").groupBy("doc_id").agg(F.collect_list("lms").alias("xs"))
    numbered = F.flatten(F.transform("xs", lambda x: F.transform(x, lambda lm, i: F.struct(i.alias("i"), lm.alias("lm")))))
    several = F.transform(F.array_sort(numbered), lambda x: x["lm"])
    return grouped.select("doc_id", F.array_join(F.when(F.size("xs") == 1, F.get("xs", 0)).otherwise(several), " ").alias("lemmatized"))


@register("distinct_tokens",
          "WITH t AS (SELECT doc_id, unnest(" + O.tokens(O.norm("text")) + ") AS term FROM documents) "
          "SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM t GROUP BY term")
def q_distinct_tokens(spark, sf):
    """The distinct token set (the memo key space of lemmatisation) with document and total counts."""
    t = docs_raw(spark, sf).select("doc_id", F.explode(T.tokens(T.normalize_text("text"))).alias("term"))
    per_doc = t.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("c").alias("n"))


# Answer-like strings derived from documents: the first 40 characters play the question.
ECHO_Q = "substring(coalesce(text, ''), 1, 40)"


@register("strip_echo",
          f"SELECT doc_id, {O.strip_echo(O.strip(DOC_TEXT), ECHO_Q)} AS post, "
          f"{O.strip_echo(O.strip(DOC_TEXT), ECHO_Q, T.ECHO_CHARS_RAW)} AS raw_stage FROM documents")
def q_strip_echo(spark, sf):
    d = docs_raw(spark, sf)
    t = T.strip(F.coalesce("text", F.lit("")))
    q = F.substring(F.coalesce("text", F.lit("")), 1, 40)
    return d.select("doc_id", T.strip_echo(t, q).alias("post"), T.strip_echo(t, q, T.ECHO_CHARS_RAW).alias("raw_stage"))


RAW_WRAP_SQL = "concat('assistant\n', coalesce(text, ''), ' assistant:')"


@register("drop_role_lines", f"SELECT doc_id, {O.drop_role_lines(RAW_WRAP_SQL)} AS line FROM documents")
def q_drop_role_lines(spark, sf):
    raw = F.concat(F.lit("assistant\n"), F.coalesce("text", F.lit("")), F.lit(" assistant:"))
    return docs_raw(spark, sf).select("doc_id", T.drop_role_lines(raw).alias("line"))


@register("strip_role_suffix", f"SELECT doc_id, {O.strip_role_suffix(RAW_WRAP_SQL)} AS out FROM documents")
def q_strip_role_suffix(spark, sf):
    raw = F.concat(F.lit("assistant\n"), F.coalesce("text", F.lit("")), F.lit(" assistant:"))
    return docs_raw(spark, sf).select("doc_id", T.strip_role_suffix(raw).alias("out"))


PREFIX_SQL = "CASE WHEN doc_id % 2 = 0 THEN 'Assistant: ' || coalesce(text, '') ELSE coalesce(text, '') END"


@register("strip_role_prefix", f"SELECT doc_id, {O.strip_role_prefix(PREFIX_SQL)} AS out FROM documents")
def q_strip_role_prefix(spark, sf):
    t = F.coalesce("text", F.lit(""))
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Assistant: "), t)).otherwise(t)
    return docs_raw(spark, sf).select("doc_id", T.strip_role_prefix(raw).alias("out"))


@register("first_sentence", f"SELECT doc_id, {O.first_sentence(O.strip(DOC_TEXT))} AS out FROM documents")
def q_first_sentence(spark, sf):
    return docs_raw(spark, sf).select("doc_id", T.first_sentence(T.strip(F.coalesce("text", F.lit("")))).alias("out"))


@register("first_sentence_min5", f"SELECT doc_id, {O.first_sentence(O.strip(DOC_TEXT), 5)} AS out FROM documents")
def q_first_sentence_min5(spark, sf):
    return docs_raw(spark, sf).select(
        "doc_id", T.first_sentence(T.strip(F.coalesce("text", F.lit(""))), min_end=5).alias("out"))


@register("is_refusal",
          f"SELECT doc_id, {O.refusal(f'lower({DOC_TEXT})')} AS refusal, "
          f"{O.refusal(f'lower({DOC_TEXT})', T.REFUSAL_PHRASES_BASIC)} AS refusal_basic FROM documents")
def q_is_refusal(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return docs_raw(spark, sf).select("doc_id", T.is_refusal(t).alias("refusal"),
                                      T.is_refusal(t, T.REFUSAL_PHRASES_BASIC).alias("refusal_basic"))


FS_SQL = O.first_sentence(O.strip(DOC_TEXT))


# every piece of a whole text, cut behind ". "
PIECES_SQL = (f"SELECT doc_id, source, i, {O.strip('s0')} AS s FROM (SELECT doc_id, source, unnest(string_split({DOC_TEXT}, '. ')) AS s0, "
              f"unnest(range(0, len(string_split({DOC_TEXT}, '. ')))) AS i FROM documents)")


def doc_pieces(spark, sf):
    d = docs_raw(spark, sf).select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\. ")).alias("i", "s0"))
    return d.select("doc_id", "source", F.col("i").cast("long").alias("i"), T.strip("s0").alias("s"))


@register("is_fragment", f"SELECT doc_id, i, {O.is_fragment('s')} AS fragment FROM ({PIECES_SQL})")
def q_is_fragment(spark, sf):
    return doc_pieces(spark, sf).select("doc_id", "i", T.is_fragment(F.col("s")).alias("fragment"))


@register("is_broken",
          f"SELECT doc_id, i, {O.is_broken('s')} AS broken_sentence, {O.is_broken('source')} AS broken_title FROM ({PIECES_SQL})")
def q_is_broken(spark, sf):
    return doc_pieces(spark, sf).select("doc_id", "i", T.is_broken(F.col("s")).alias("broken_sentence"),
                                        T.is_broken(F.col("source")).alias("broken_title"))


@register("extract_translation", f"SELECT doc_id, {O.translation(O.strip(DOC_TEXT))} AS eng FROM documents")
def q_extract_translation(spark, sf):
    return docs_raw(spark, sf).select("doc_id", T.extract_translation(T.strip(F.coalesce("text", F.lit("")))).alias("eng"))


@register("cap_words",
          f"SELECT doc_id, {O.cap_words(DOC_TEXT, T.CAP_WORDS)} AS capped, {O.cap_words(DOC_TEXT, T.CAP_WORDS_BASIC)} AS capped20 FROM documents")
def q_cap_words(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return docs_raw(spark, sf).select("doc_id", T.cap_words(t, T.CAP_WORDS).alias("capped"),
                                      T.cap_words(t, T.CAP_WORDS_BASIC).alias("capped20"))


CLEAN_Q_SQL = (f"CASE WHEN doc_id % 3 = 0 THEN {O.lit(T.TRANSLATE_TRIGGER.capitalize() + ': ')} || coalesce(source, '') "
               f"WHEN doc_id % 3 = 1 THEN substring(coalesce(text, ''), 1, 30) ELSE source END")


def _clean_q():
    t = F.coalesce("text", F.lit(""))
    return (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(T.TRANSLATE_TRIGGER.capitalize() + ": "), F.coalesce("source", F.lit(""))))
            .when(F.col("doc_id") % 3 == 1, F.substring(t, 1, 30)).otherwise(F.col("source")))


@register("clean_answer",
          f"SELECT doc_id, cleaned FROM ({O.clean_answer(f'(SELECT doc_id, text, {CLEAN_Q_SQL} AS q FROM documents)', 'text', 'q', 'cleaned')})")
def q_clean_answer(spark, sf):
    d = docs_raw(spark, sf).withColumn("q", _clean_q())
    return T.clean_answer(d, "text", "q", "cleaned").select("doc_id", "cleaned")


@register("clean_answer_basic",
          f"SELECT doc_id, cleaned FROM ({O.clean_answer_basic(f'(SELECT doc_id, text, {CLEAN_Q_SQL} AS q FROM documents)', 'text', 'q', 'cleaned')})")
def q_clean_answer_basic(spark, sf):
    d = docs_raw(spark, sf).withColumn("q", _clean_q())
    return T.clean_answer_basic(d, "text", "q", "cleaned").select("doc_id", "cleaned")


@register("clean_raw_output",
          f"SELECT doc_id, cleaned FROM ({O.clean_raw_output(f'(SELECT doc_id, {ECHO_Q} AS q, {ECHO_Q} || {O.lit(chr(8212) + ' assistant' + chr(10))} || coalesce(text, {chr(39) * 2}) || {O.lit(' assistant:')} AS raw FROM documents)', 'raw', 'q', 'cleaned')})")
def q_clean_raw_output(spark, sf):
    """I4: plain-route raw cleanup over wrapped document texts."""
    t = F.coalesce("text", F.lit(""))
    q = F.substring(t, 1, 40)
    d = docs_raw(spark, sf).select("doc_id", q.alias("q"), F.concat(q, F.lit("— assistant\n"), t, F.lit(" assistant:")).alias("raw"))
    return T.clean_raw_output(d, "raw", "q", "cleaned").select("doc_id", "cleaned")


@register("ellipsize",
          f"SELECT item_id, {O.ellipsize('text', 120)} AS q120, {O.ellipsize('text', 63)} AS q60, substring(text, 1, 500) AS a500 FROM benchmark")
def q_ellipsize(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", T.ellipsize("text", 120).alias("q120"), T.ellipsize("text", 63).alias("q60"),
                    F.substring("text", 1, 500).alias("a500"))


# --- C: arithmetic rules over questions derived from lineitem / part --------
# Expected values in SQL are computed from the operands, not by parsing.

LI_A = "CAST(floor(l_quantity) AS BIGINT)"
LI_B = "CAST(l_linenumber - 1 AS BIGINT)"
BIN_OPS = ["плюс", "минус", "умножить на", "разделить на", "/", "×", "+", "-", ":", "*", "x"]


def _li(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.floor("l_quantity").cast("long").alias("a"),
                     (F.col("l_linenumber") - 1).cast("long").alias("b"),
                     F.floor("l_extendedprice").cast("long").alias("price"), "l_suppkey")


def _pick(options, idx):
    return F.element_at(F.array(*[F.lit(o) for o in options]), (idx % len(options) + 1).cast("int"))


def _pick_sql(options, idx):
    return f"[{', '.join(O.lit(o) for o in options)}][({idx}) % {len(options)} + 1]"


def _sql_binary_value(op, a, b):
    return (f"CASE WHEN {op} IN ('плюс', '+') THEN {a} + {b} WHEN {op} IN ('минус', '-') THEN {a} - {b} "
            f"WHEN {op} IN ('умножить на', '×', '*', 'x') THEN {a} * {b} ELSE CAST({a} AS DOUBLE) / nullif({b}, 0) END")


def _sql_answer(value, refuse_cond="false"):
    return f"CASE WHEN {refuse_cond} THEN {O.REFUSE} ELSE {O.fmt_number(f'CAST({value} AS DOUBLE)')} END"


MB_OP = _pick_sql(BIN_OPS, "l_orderkey + l_linenumber")
MB_SQL = (f"WITH x AS (SELECT l_orderkey, l_linenumber, {LI_A} AS a, {LI_B} AS b, {MB_OP} AS op FROM lineitem) "
          f"SELECT l_orderkey, l_linenumber, 'Сколько будет ' || a || ' ' || op || ' ' || b || '?' AS question, "
          f"{_sql_answer(_sql_binary_value('op', 'a', 'b'), 'op IN (' + chr(39) + 'разделить на' + chr(39) + ', ' + chr(39) + '/' + chr(39) + ', ' + chr(39) + ':' + chr(39) + ') AND b = 0')} AS answer FROM x")


@register("math_binary", MB_SQL)
def q_math_binary(spark, sf):
    x = _li(spark, sf).withColumn("op", _pick(BIN_OPS, F.col("l_orderkey") + F.col("l_linenumber")))
    x = x.withColumn("question", F.concat(F.lit("Сколько будет "), F.col("a"), F.lit(" "), F.col("op"), F.lit(" "), F.col("b"), F.lit("?")))
    return A.with_rule(x, "question", "math_binary", "answer").select("l_orderkey", "l_linenumber", "question", "answer")


DIV_OPS = ["разделить на", "/", " : "]


@register("math_divide",
          f"WITH x AS (SELECT l_orderkey, l_linenumber, {LI_A} AS a, {LI_B} AS b, {_pick_sql(DIV_OPS, 'l_orderkey')} AS op FROM lineitem) "
          f"SELECT l_orderkey, l_linenumber, 'Открыто ' || a || op || b AS question, "
          f"{_sql_answer('CAST(a AS DOUBLE) / nullif(b, 0)', 'b = 0')} AS answer FROM x")
def q_math_divide(spark, sf):
    x = _li(spark, sf).withColumn("op", _pick(DIV_OPS, F.col("l_orderkey")))
    x = x.withColumn("question", F.concat(F.lit("Открыто "), F.col("a"), F.col("op"), F.col("b")))
    return A.with_rule(x, "question", "math_divide", "answer").select("l_orderkey", "l_linenumber", "question", "answer")


MUL_OPS = ["умножить на", "*", "x", "×"]


@register("math_multiply",
          f"WITH x AS (SELECT l_orderkey, l_linenumber, {LI_A} AS a, {LI_B} AS b, {_pick_sql(MUL_OPS, 'l_orderkey')} AS op FROM lineitem) "
          f"SELECT l_orderkey, l_linenumber, a || ' ' || op || ' ' || b AS question, {_sql_answer('a * b')} AS answer FROM x")
def q_math_multiply(spark, sf):
    x = _li(spark, sf).withColumn("op", _pick(MUL_OPS, F.col("l_orderkey")))
    x = x.withColumn("question", F.concat(F.col("a"), F.lit(" "), F.col("op"), F.lit(" "), F.col("b")))
    return A.with_rule(x, "question", "math_multiply", "answer").select("l_orderkey", "l_linenumber", "question", "answer")


@register("math_sum",
          f"WITH x AS (SELECT l_orderkey, l_linenumber, {LI_A} AS a, CAST(floor(l_extendedprice) AS BIGINT) AS b FROM lineitem) "
          f"SELECT l_orderkey, l_linenumber, 'Сумма чисел ' || a || ' и ' || b AS question, {_sql_answer('a + b')} AS answer FROM x")
def q_math_sum(spark, sf):
    x = _li(spark, sf).withColumn("question", F.concat(F.lit("Сумма чисел "), F.col("a"), F.lit(" и "), F.col("price")))
    return A.with_rule(x, "question", "math_sum", "answer").select("l_orderkey", "l_linenumber", "question", "answer")


PCT_WORDS = ["процентов", "процента", "процент"]


@register("math_percent",
          f"WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber * 5 AS p, CAST(floor(l_extendedprice) AS BIGINT) AS b, "
          f"{_pick_sql(PCT_WORDS, 'l_orderkey')} AS w FROM lineitem) "
          f"SELECT l_orderkey, l_linenumber, p || ' ' || w || ' от ' || b AS question, {_sql_answer('b * CAST(p AS DOUBLE) / 100.0')} AS answer FROM x")
def q_math_percent(spark, sf):
    x = _li(spark, sf).withColumn("p", F.col("l_linenumber") * 5).withColumn("w", _pick(PCT_WORDS, F.col("l_orderkey")))
    x = x.withColumn("question", F.concat(F.col("p"), F.lit(" "), F.col("w"), F.lit(" от "), F.col("price")))
    return A.with_rule(x, "question", "math_percent", "answer").select("l_orderkey", "l_linenumber", "question", "answer")


@register("math_mean",
          f"WITH x AS (SELECT l_orderkey, l_linenumber, {LI_A} AS a, CAST(l_linenumber AS BIGINT) AS b, l_suppkey AS c FROM lineitem) "
          f"SELECT l_orderkey, l_linenumber, 'Среднее арифметическое чисел ' || a || ', ' || b || ', ' || c AS question, "
          f"{_sql_answer('(a + b + c) / 3.0')} AS answer FROM x")
def q_math_mean(spark, sf):
    x = _li(spark, sf).withColumn("question", F.concat(F.lit("Среднее арифметическое чисел "), F.col("a"), F.lit(", "),
                                                      F.col("l_linenumber"), F.lit(", "), F.col("l_suppkey")))
    return A.with_rule(x, "question", "math_mean", "answer").select("l_orderkey", "l_linenumber", "question", "answer")


SQRT_N = "CAST(p_size AS BIGINT) * p_size + (p_partkey % 2)"


@register("math_sqrt",
          f"SELECT p_partkey, 'Квадратный корень из ' || ({SQRT_N}) AS question, "
          f"{_sql_answer('p_size', 'p_partkey % 2 = 1 AND p_size > 0')} AS answer FROM part")
def q_math_sqrt(spark, sf):
    p = table(spark, sf, "part")
    n = F.col("p_size").cast("long") * F.col("p_size") + F.col("p_partkey") % 2
    x = p.select("p_partkey", F.concat(F.lit("Квадратный корень из "), n).alias("question"))
    return A.with_rule(x, "question", "math_sqrt", "answer")


ORD_WORDS = list(A.ORDINAL_POWERS) + ["первой"]


@register("math_power",
          f"WITH x AS (SELECT p_partkey, p_size % 10 + 1 AS b, {_pick_sql(ORD_WORDS, 'p_partkey')} AS w FROM part), "
          f"y AS (SELECT *, CASE " + " ".join(f"WHEN w = {O.lit(k)} THEN {v}" for k, v in A.ORDINAL_POWERS.items()) + " END AS e FROM x) "
          f"SELECT p_partkey, b || ' в ' || w || ' степени' AS question, "
          f"CASE WHEN e IS NULL THEN NULL ELSE {O.fmt_number('pow(b, e)')} END AS answer FROM y")
def q_math_power(spark, sf):
    p = table(spark, sf, "part")
    x = p.select("p_partkey", (F.col("p_size") % 10 + 1).alias("b"), _pick(ORD_WORDS, F.col("p_partkey")).alias("w"))
    x = x.withColumn("question", F.concat(F.col("b"), F.lit(" в "), F.col("w"), F.lit(" степени")))
    return A.with_rule(x, "question", "math_power", "answer").select("p_partkey", "question", "answer")


CIRCLE_R = "CAST(floor(p_retailprice / 100) AS BIGINT) || ',' || p_size"


@register("math_circle",
          f"WITH x AS (SELECT p_partkey, {CIRCLE_R} AS rs, p_partkey % 2 = 0 AS with_pi FROM part), "
          f"y AS (SELECT *, CAST(replace(rs, ',', '.') AS DOUBLE) AS r FROM x) "
          f"SELECT p_partkey, 'Площадь круга радиуса ' || rs || CASE WHEN with_pi THEN ' при π=3,14' ELSE '' END AS question, "
          f"{O.fmt_number('CASE WHEN with_pi THEN 3.14 ELSE ' + str(A.DEFAULT_PI) + ' END * (r * r)')} AS answer FROM y")
def q_math_circle(spark, sf):
    p = table(spark, sf, "part")
    rs = F.concat(F.floor(F.col("p_retailprice") / 100).cast("long"), F.lit(","), F.col("p_size"))
    x = p.select("p_partkey", rs.alias("rs"), (F.col("p_partkey") % 2 == 0).alias("with_pi"))
    x = x.withColumn("question", F.concat(F.lit("Площадь круга радиуса "), F.col("rs"),
                                          F.when(F.col("with_pi"), F.lit(" при π=3,14")).otherwise(F.lit(""))))
    return A.with_rule(x, "question", "math_circle", "answer").select("p_partkey", "question", "answer")


def _format_number_source(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_linenumber")).alias("v"))


@register("format_number_ru",
          f"SELECT l_orderkey, l_linenumber, {O.fmt_number('l_extendedprice / l_linenumber')} AS formatted FROM lineitem")
def q_format_number_ru(spark, sf):
    return _format_number_source(spark, sf).select("l_orderkey", "l_linenumber", A.format_number_ru("v").alias("formatted"))


MIXED_Q_SQL = (
    "SELECT 2 * CAST(item_id AS BIGINT) AS qid, text AS question FROM benchmark UNION ALL "
    f"SELECT 2 * p_partkey + 1, CASE p_partkey % 4 WHEN 0 THEN 'Сколько будет ' || p_size || ' плюс ' || (p_partkey % 9) "
    "WHEN 1 THEN 'Квадратный корень из ' || (p_size * p_size) WHEN 2 THEN (p_size % 10 + 1) || ' в третьей степени' "
    "ELSE p_name || '?' END FROM part"
)


def mixed_questions(spark, sf):
    """Benchmark questions (even ids) plus rule questions derived from every part row (odd ids)."""
    b = table(spark, sf, "benchmark").select((2 * F.col("item_id").cast("long")).alias("qid"), F.col("text").alias("question"))
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    q = (F.when(k == 0, F.concat(F.lit("Сколько будет "), F.col("p_size"), F.lit(" плюс "), F.col("p_partkey") % 9))
         .when(k == 1, F.concat(F.lit("Квадратный корень из "), F.col("p_size") * F.col("p_size")))
         .when(k == 2, F.concat(F.col("p_size") % 10 + 1, F.lit(" в третьей степени")))
         .otherwise(F.concat(F.col("p_name"), F.lit("?"))))
    return b.unionByName(p.select((2 * F.col("p_partkey").cast("long") + 1).alias("qid"), q.alias("question")))


@register("math_answer", f"SELECT qid, question, math AS answer FROM ({O.math_select(f'({MIXED_Q_SQL})', 'question', 'math')})")
def q_math_answer(spark, sf):
    return A.with_math_answer(mixed_questions(spark, sf), "question", "answer")


# --- E: chunks ----------------------------------------------------------------

@register("chunk_documents", f"WITH {O.documents_cte()}, {O.chunks_cte()} SELECT doc_id, pos, title, text FROM chunks")
def q_chunk_documents(spark, sf):
    return CH.chunk_documents(prepared_docs(spark, sf)).select("doc_id", "pos", "title", "text")


@register("chunk_numbering",
          f"WITH {O.documents_cte()}, {O.chunks_cte()} SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id, doc_id, pos FROM chunks")
def q_chunk_numbering(spark, sf):
    chunks = CH.chunk_documents(prepared_docs(spark, sf)).select("doc_id", "pos")
    return CH.number_chunks(spark, chunks).select("chunk_id", "doc_id", "pos")


# --- F: vectors, scoring, top-k, context --------------------------------------

def corpus_of(spark, sf):
    return build_corpus(prepared_docs(spark, sf))


def bench_questions(spark, sf):
    from .answer import load_benchmark_questions

    return load_benchmark_questions(spark, sf)


RETR_BASE = f"{O.documents_cte()}, {O.chunks_cte()}, {O.benchmark_questions_cte()}, {O.retrieval_ctes('qs')}"


@register("encode_terms", f"WITH {O.documents_cte()}, {O.chunks_cte()}, {O.vectors_cte('cvec', 'chunks', 'doc_id, pos', 'text')} "
          "SELECT doc_id, pos, term, round(w, 9) AS w FROM cvec")
def q_encode_terms(spark, sf):
    """F2 default encoder: unit term-frequency vectors of every chunk."""
    v = corpus_of(spark, sf).vectors
    return v.select("doc_id", "pos", "term", F.round("w", 9).alias("w"))


@register("l2_normalize",
          "WITH e AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nrm FROM embeddings), "
          "u AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x, nrm FROM e) "
          "SELECT vec_id, i, round(CASE WHEN nrm > 0 THEN CAST(x AS DOUBLE) / nrm ELSE 0.0 END, 9) AS x FROM u")
def q_l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(V.l2_normalize("embedding")).alias("i", "x")).select(
        "vec_id", F.col("i").cast("long").alias("i"), F.round("x", 9).alias("x"))


DENSE_PAIRS = ("pairs AS (SELECT q.vec_id AS qid, c.vec_id, "
               "list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score "
               "FROM embeddings q, embeddings c)")


@register("top_k_dense",
          f"WITH {DENSE_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM pairs) "
          "SELECT qid, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3")
def q_top_k_dense(spark, sf):
    """F3 + F5: every embedding as a query against all embeddings (exact, block-scored)."""
    e = table(spark, sf, "embeddings")
    top = V.dense_top_k(spark, e.select(F.col("vec_id").alias("qid"), "embedding"), e, 3)
    return top.select("qid", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("dense_scores",
          f"WITH {DENSE_PAIRS} SELECT qid, count(*) AS n, round(max(score), 6) AS best, round(sum(score), 4) AS total FROM pairs GROUP BY qid")
def q_dense_scores(spark, sf):
    """all-pairs exact scores, aggregated per query (count, best, sum) to keep the output per query."""
    rows = V.vector_rows(table(spark, sf, "embeddings"), "vec_id", "embedding")
    found = V.dense_score_stats(rows, V.vector_blocks(rows, scratch_path(spark, "corpus-blocks")))
    return found.select("qid", "n", F.round("best", 6).alias("best"), F.round("total", 4).alias("total"))


@register("sparse_scores", f"WITH {RETR_BASE} SELECT qid, doc_id, pos, round(score, 6) AS score FROM scores")
def q_sparse_scores(spark, sf):
    c = corpus_of(spark, sf)
    s = TB.block_pairs(written(TB.question_blocks(bench_questions(spark, sf)), "question-blocks"), c.blocks)
    return s.select("qid", "doc_id", "pos", F.round("score", 6).alias("score"))


@register("top_k_sparse", f"WITH {RETR_BASE} SELECT qid, rank, doc_id, pos, round(score, 6) AS score FROM top")
def q_top_k_sparse(spark, sf):
    c = corpus_of(spark, sf)
    t = top_chunks(bench_questions(spark, sf), c, 3)
    return t.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", "pos", F.round("score", 6).alias("score"))


@register("fetch_chunks",
          f"WITH {RETR_BASE}, ids AS (SELECT qid, rank, doc_id, pos FROM top UNION ALL SELECT qid, 0, -1, 0 FROM qs "
          f"UNION ALL SELECT qid, 9, (SELECT max(doc_id) + 1 FROM documents), 0 FROM qs) "
          "SELECT i.qid, i.rank, i.doc_id, i.pos, coalesce(c.title, '') AS title, coalesce(c.text, '') AS text "
          "FROM ids i LEFT JOIN chunks c ON i.doc_id = c.doc_id AND i.pos = c.pos")
def q_fetch_chunks(spark, sf):
    """F6 with missing ids (-1 and max+1) added per question: they fetch ''."""
    c = corpus_of(spark, sf)
    qs = bench_questions(spark, sf)
    t = top_chunks(qs, c, 3).select("qid", "rank", "doc_id", "pos")
    mx = table(spark, sf, "documents").agg((F.max("doc_id") + 1).alias("m")).first()["m"]  # one scalar
    extra = qs.select("qid", F.lit(0).alias("rank"), F.lit(-1).cast("long").alias("doc_id"), F.lit(0).alias("pos")).unionByName(
        qs.select("qid", F.lit(9).alias("rank"), F.lit(mx).cast("long").alias("doc_id"), F.lit(0).alias("pos")))
    ids = t.withColumn("rank", F.col("rank").cast("int")).unionByName(extra)
    out = CX.fetch_chunks(ids, c.chunks)
    return out.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", "pos", "title", "text")


@register("trim_pieces", f"WITH {RETR_BASE} SELECT qid, rank, piece FROM pieces")
def q_trim_pieces(spark, sf):
    c = corpus_of(spark, sf)
    t = top_chunks(bench_questions(spark, sf), c, 3)
    f = CX.fetch_chunks(t, c.chunks)
    return f.select("qid", F.col("rank").cast("long").alias("rank"), CX.trim_piece(3).alias("piece"))


@register("build_context", f"WITH {RETR_BASE} SELECT qid, round(best_score, 6) AS best_score, ctx FROM retr")
def q_build_context(spark, sf):
    r = retrieve(bench_questions(spark, sf), corpus_of(spark, sf))
    return r.select("qid", F.round("best_score", 6).alias("best_score"), "ctx")


@register("build_context_basic",
          f"WITH {RETR_BASE} SELECT qid, string_agg(substring(text, 1, 466), chr(10) || chr(10) ORDER BY rank) AS ctx FROM fetched GROUP BY qid")
def q_build_context_basic(spark, sf):
    c = corpus_of(spark, sf)
    t = top_chunks(bench_questions(spark, sf), c, 3)
    return CX.build_context_basic(CX.fetch_chunks(t, c.chunks), ["qid"], 3)


@register("retrieve_context",
          f"WITH {RETR_BASE}, agg AS (SELECT qid, string_agg(doc_id || ':' || pos, ',' ORDER BY rank) AS ids, "
          "string_agg(CAST(round(score, 6) AS VARCHAR), ',' ORDER BY rank) AS scores FROM top GROUP BY qid) "
          "SELECT r.qid, a.ids, round(r.best_score, 6) AS best_score, r.ctx FROM retr r JOIN agg a ON r.qid = a.qid")
def q_retrieve_context(spark, sf):
    """scores, ids and context per question (ids rendered ``doc:pos`` in rank order)."""
    r = retrieve(bench_questions(spark, sf), corpus_of(spark, sf))
    ids = F.array_join(F.transform("ids", lambda x: F.concat(x["doc_id"], F.lit(":"), x["pos"])), ",")
    return r.select("qid", ids.alias("ids"), F.round("best_score", 6).alias("best_score"), "ctx")


GATED = (f"WITH {RETR_BASE}, judged AS (SELECT q.qid, q.question, x.best_score, x.ctx, "
         f"{O.gate('x.best_score', 'x.ctx')} AS ok FROM qs q LEFT JOIN retr x ON q.qid = x.qid) ")


def _judged(spark, sf):
    qs = bench_questions(spark, sf)
    r = retrieve(qs, corpus_of(spark, sf))
    return qs.join(r, "qid", "left").withColumn("ok", R.gate("best_score", "ctx"))


@register("accepted_questions", GATED + "SELECT q.qid, q.question FROM qs q WHERE q.qid IN (SELECT qid FROM judged WHERE ok)")
def q_accepted_questions(spark, sf):
    """F11 semi-join: questions with a usable context."""
    ok = _judged(spark, sf).filter("ok").select("qid")
    return bench_questions(spark, sf).join(ok, "qid", "left_semi")


@register("refused_questions", GATED + "SELECT q.qid, q.question FROM qs q WHERE q.qid NOT IN (SELECT qid FROM judged WHERE ok)")
def q_refused_questions(spark, sf):
    """F11 anti-join: questions without a usable context."""
    ok = _judged(spark, sf).filter("ok").select("qid")
    return bench_questions(spark, sf).join(ok, "qid", "left_anti")


# --- G: gates and routing -------------------------------------------------------

@register("best_score", GATED + "SELECT qid, round(coalesce(best_score, 0.0), 6) AS best_score FROM judged")
def q_best_score(spark, sf):
    return _judged(spark, sf).select("qid", F.round(R.best_score("best_score"), 6).alias("best_score"))


@register("score_gate", GATED + "SELECT qid, ok FROM judged")
def q_score_gate(spark, sf):
    return _judged(spark, sf).select("qid", "ok")


def _reasons_sql():
    c = O.strip("coalesce(ctx, '')")
    return (f"array_to_string(list_filter([CASE WHEN best_score IS NULL THEN 'no_scores' END, "
            f"CASE WHEN best_score IS NOT NULL AND best_score < {R.THRESHOLD} THEN 'low_score_' || printf('%.4f', best_score) || '<{R.THRESHOLD}' END, "
            f"CASE WHEN length({c}) = 0 THEN 'empty_context' END], lambda z: z IS NOT NULL), ', ')")


@register("rejection_reasons", GATED + f"SELECT qid, {_reasons_sql()} AS reasons FROM judged")
def q_rejection_reasons(spark, sf):
    return _judged(spark, sf).select("qid", R.rejection_reasons("best_score", "ctx").alias("reasons"))


@register("route_questions",
          f"WITH {O.documents_cte()}, {O.chunks_cte()}, qs AS ({MIXED_Q_SQL}), routed AS ({O.math_select('qs', 'question', 'math')}), "
          f"rest AS (SELECT qid, question FROM routed WHERE math IS NULL), {O.retrieval_ctes('rest')}, "
          f"judged AS (SELECT r.qid, {O.gate('x.best_score', 'x.ctx')} AS ok FROM rest r LEFT JOIN retr x ON r.qid = x.qid) "
          "SELECT q.qid, CASE WHEN q.math IS NOT NULL THEN 'math' WHEN j.ok THEN 'context' ELSE 'refused' END AS route "
          "FROM routed q LEFT JOIN judged j ON q.qid = j.qid")
def q_route_questions(spark, sf):
    """Rule questions -> math; others by the score gate -> context / refused."""
    q = A.with_math_answer(mixed_questions(spark, sf), "question", "math").checkpoint(eager=True)
    rest = q.filter(F.col("math").isNull()).select("qid", "question")
    r = retrieve(rest, corpus_of(spark, sf))
    judged = rest.join(r, "qid", "left").select("qid", R.gate("best_score", "ctx").alias("ok"))
    out = q.join(judged, "qid", "left")
    route = F.when(F.col("math").isNotNull(), "math").when(F.col("ok"), "context").otherwise("refused")
    return out.select("qid", route.alias("route"))


MIXED_QS_CTE = f"qs AS ({MIXED_Q_SQL})"


@register("merge_answers", O.flagship(qs_cte=MIXED_QS_CTE))
def q_merge_answers(spark, sf):
    """G5 (+ G4, G7): benchmark and rule questions answered and merged in question order."""
    return answer_questions(mixed_questions(spark, sf), corpus_of(spark, sf))


@register("refuse_broken", f"SELECT doc_id, i, CASE WHEN {O.is_broken('s')} THEN {O.REFUSE} ELSE s END AS answer FROM ({PIECES_SQL})")
def q_refuse_broken(spark, sf):
    """G7 over all sentences of documents."""
    return doc_pieces(spark, sf).select("doc_id", "i", R.refuse_broken(F.col("s")).alias("answer"))


PRIMARY_SQL = f"CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN {O.REFUSE} ELSE s END"
ALT_SQL = f"CASE WHEN doc_id % 5 = 0 THEN {O.REFUSE} WHEN doc_id % 5 = 1 THEN ' ' ELSE source END"


def _primary_alt(spark, sf):
    k4, k5 = F.col("doc_id") % 4, F.col("doc_id") % 5
    primary = F.when(k4 == 0, F.lit("")).when(k4 == 1, F.lit(T.REFUSE)).otherwise(F.col("s"))
    alt = F.when(k5 == 0, F.lit(T.REFUSE)).when(k5 == 1, F.lit(" ")).otherwise(F.col("source"))
    return doc_pieces(spark, sf).select("doc_id", "i", primary.alias("primary"), alt.alias("alt"))


def _bad_sql(p):
    return f"({p} IS NULL OR length({O.strip(p)}) = 0 OR {O.is_broken(p)} OR lower({O.strip(p)}) = lower({O.REFUSE}))"


@register("fallback_answer",
          f"WITH x AS (SELECT doc_id, i, {PRIMARY_SQL} AS p, {ALT_SQL} AS a FROM ({PIECES_SQL})) "
          f"SELECT doc_id, i, CASE WHEN {_bad_sql('p')} THEN (CASE WHEN length(a) > 0 AND lower({O.strip('a')}) <> lower({O.REFUSE}) THEN a "
          f"WHEN length(p) > 0 THEN p ELSE {O.REFUSE} END) ELSE p END AS answer FROM x")
def q_fallback_answer(spark, sf):
    return _primary_alt(spark, sf).select("doc_id", "i", R.fallback_answer("primary", "alt").alias("answer"))


@register("fallback_answer_chat",
          f"WITH x AS (SELECT doc_id, i, {PRIMARY_SQL} AS p, {ALT_SQL} AS a FROM ({PIECES_SQL})), "
          f"y AS (SELECT doc_id, i, CASE WHEN {_bad_sql('p')} AND length(a) > 0 AND lower({O.strip('a')}) <> lower({O.REFUSE}) "
          f"AND NOT {O.is_broken('a')} THEN a ELSE p END AS c FROM x) "
          f"SELECT doc_id, i, CASE WHEN length(coalesce(c, '')) > 0 THEN c ELSE {O.REFUSE} END AS answer FROM y")
def q_fallback_answer_chat(spark, sf):
    return _primary_alt(spark, sf).select("doc_id", "i", R.fallback_answer_chat("primary", "alt").alias("answer"))


@register("answer_questions_plain",
          f"WITH qs AS ({MIXED_Q_SQL}), routed AS ({O.math_select('qs', 'question', 'math')}) "
          f"SELECT qid, question, coalesce(math, {O.REFUSE}) AS answer, CASE WHEN math IS NULL THEN 'plain' ELSE 'math' END AS route, "
          "CAST(NULL AS DOUBLE) AS best_score FROM routed")
def q_answer_questions_plain(spark, sf):
    """G4 no-index route + G6 strict retry with the default (model-free) generator: rule answers, else REFUSE."""
    return answer_questions(mixed_questions(spark, sf), None, Options(use_index=False))


# --- H: conversations ------------------------------------------------------------

from ..operators import conversations as H  # noqa: E402

CONV_MSG_SQL = "'[' || upper(coalesce(role, 'user')) || ']' || chr(10) || coalesce(text, '')"


@register("chat_history",
          f"SELECT conv_id, turn, count(*) OVER w AS n_msgs, array_to_string(list({CONV_MSG_SQL}) OVER w, chr(10) || chr(10)) AS history "
          "FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def q_chat_history(spark, sf):
    """H1: accumulated history at every turn (rendered, plus its message count)."""
    h = H.with_history(table(spark, sf, "conversations"))
    parts = F.transform("history", lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"]))
    return h.select("conv_id", "turn", F.size("history").cast("long").alias("n_msgs"), F.array_join(parts, "\n\n").alias("history"))


@register("chat_segments",
          "WITH s AS (SELECT *, sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM conversations) "
          "SELECT conv_id, turn, segment, count(*) OVER (PARTITION BY conv_id, segment ORDER BY turn "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_msgs FROM s")
def q_chat_segments(spark, sf):
    """H2: history resets (flag ``turn % 3 = 0``) split a conversation into segments."""
    s = H.history_ranges(table(spark, sf, "conversations"), F.col("turn") % 3 == 0)
    return s.select("conv_id", "turn", "segment", (F.col("pos") - F.col("first_pos") + 1).alias("n_msgs"))


@register("chat_segment_history",
          "WITH s AS (SELECT *, sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM conversations) "
          f"SELECT conv_id, turn, array_to_string(list({CONV_MSG_SQL}) OVER (PARTITION BY conv_id, segment ORDER BY turn "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), chr(10) || chr(10)) AS history FROM s")
def q_chat_segment_history(spark, sf):
    """H1 + H2: the history since the last reset at every turn."""
    h = H.with_history(table(spark, sf, "conversations"), F.col("turn") % 3 == 0)
    parts = F.transform("history", lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"]))
    return h.select("conv_id", "turn", F.array_join(parts, "\n\n").alias("history"))


def _seed_sql(prompt):
    return f"CAST('0x' || substr(md5('127:' || {prompt}), 1, 15) AS BIGINT)"


CHAT_PROMPT_SQL = (
    "hp AS (SELECT conv_id, turn, role, text, list(CASE WHEN length(" + O.strip("coalesce(text, '')") + ") > 0 THEN "
    "'[' || upper(coalesce(role, 'user')) || ']' || chr(10) || coalesce(text, '') END) OVER (PARTITION BY conv_id ORDER BY turn "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS msgs FROM conversations), "
    "cp AS (SELECT conv_id, turn, coalesce(text, '') AS question, 1 + len(list_filter(msgs, lambda m: m IS NOT NULL)) AS n_prompt, "
    f"'[SYSTEM]' || chr(10) || {O.lit(P.CODE_SYSTEM_PROMPT)} || "
    "coalesce(chr(10) || chr(10) || array_to_string(list_filter(msgs, lambda m: m IS NOT NULL), chr(10) || chr(10)), '') "
    f"|| chr(10) || chr(10) || {O.lit(P.FLAT_ASSISTANT)} AS prompt FROM hp WHERE coalesce(role, 'user') = 'user')"
)
# make_code_generator, restated
CODE_RAW_SQL = ("CASE length(prompt) % 4 WHEN 0 THEN '' WHEN 1 THEN 'Assistant: print(' || (" + _seed_sql("prompt") + " % 1000) || ')' || chr(10) "
                "WHEN 2 THEN 'слово' ELSE ' x = ' || (" + _seed_sql("prompt") + " % 7) || ' # штраф 1.1 ' END")
CHAT_QS_CTE = (CHAT_PROMPT_SQL + ", ct AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS qid FROM cp), qs AS (SELECT qid, question FROM ct)")
CHAT_TAIL = (
    f", pr AS (SELECT qid, conv_id, turn, n_prompt, {O.strip('raw')} AS raw FROM (SELECT *, {CODE_RAW_SQL} AS raw FROM ct)), "
    f"pa AS (SELECT pr.qid, pr.conv_id, pr.turn, pr.n_prompt, {O.strip_role_prefix('raw')} AS p, a.answer AS a FROM pr LEFT JOIN allr a ON pr.qid = a.qid), "
    f"ch AS (SELECT *, CASE WHEN {_bad_sql('p')} AND a IS NOT NULL AND length({O.strip('a')}) > 0 AND lower({O.strip('a')}) <> lower({O.REFUSE}) "
    f"AND NOT {O.is_broken('a')} THEN a ELSE p END AS c FROM pa) "
    f"SELECT conv_id, turn, n_prompt, CASE WHEN length(coalesce(c, '')) > 0 THEN c ELSE {O.REFUSE} END AS reply FROM ch"
)


def _chat_replies_sql():
    # the flagship's CTEs, then the chat tail (the code model's reply and the chat fallback)
    return O.flagship(qs_cte=CHAT_QS_CTE, tail="__TAIL__").replace(") __TAIL__", ")" + CHAT_TAIL, 1)


@register("chat_replies", _chat_replies_sql())
def q_chat_replies(spark, sf):
    """H3: every user turn replayed: chat prompt (D5), code generator under its profile, role-prefix strip (B9),
    fallback to the retrieval answer (G8 chat form), REFUSE if empty."""
    from ..operators.inference import Generators
    from ..operators.toy_models import make_code_generator
    from .chat import chat_replies

    return chat_replies(table(spark, sf, "conversations"), corpus_of(spark, sf), gens=Generators(code=make_code_generator))


# --- D: prompts -----------------------------------------------------------------

def _flat_sql(*msgs):
    """D6 in SQL for a fixed list of (role, content-expression) messages."""
    parts = [f"'[{role.upper()}]' || chr(10) || {content}" for role, content in msgs]
    return "(" + " || chr(10) || chr(10) || ".join(parts) + f" || chr(10) || chr(10) || {O.lit(P.FLAT_ASSISTANT)})"


@register("prompt_plain",
          f"SELECT item_id AS qid, {_flat_sql(('user', 'text'))} AS engine, "
          f"{_flat_sql(('system', O.lit(P.SYSTEM_PROMPT)), ('user', 'text'))} AS notebook FROM benchmark")
def q_prompt_plain(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("qid"), P.render_flat(P.prompt_plain("text")).alias("engine"),
                    P.render_flat(P.prompt_plain("text", with_system=True)).alias("notebook"))


@register("prompt_strict",
          f"SELECT item_id AS qid, {_flat_sql(('system', O.lit(P.STRICT_PROMPT)), ('user', 'text'))} AS engine, "
          f"{_flat_sql(('system', O.lit(P.STRICT_PROMPT_NOTEBOOK)), ('user', 'text'))} AS notebook FROM benchmark")
def q_prompt_strict(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("qid"), P.render_flat(P.prompt_strict("text")).alias("engine"),
                    P.render_flat(P.prompt_strict("text", notebook=True)).alias("notebook"))


@register("prompt_code", f"SELECT item_id AS qid, {_flat_sql(('system', O.lit(P.CODE_SYSTEM_PROMPT)), ('user', 'text'))} AS prompt FROM benchmark")
def q_prompt_code(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("qid"), P.render_flat(P.prompt_code("text")).alias("prompt"))


CTX_USER_SQL = f"({O.lit(P.CONTEXT_INSTRUCTION + P.CONTEXT_LABEL)} || ctx || {O.lit(P.QUESTION_LABEL)} || question)"


@register("prompt_context",
          GATED + f"SELECT qid, {_flat_sql(('system', O.lit(P.CONTEXT_SYSTEM_PROMPT)), ('user', CTX_USER_SQL))} AS prompt FROM judged WHERE ok")
def q_prompt_context(spark, sf):
    """D3 for every accepted question (context from retrieval)."""
    j = _judged(spark, sf).filter("ok")
    return j.select("qid", P.render_flat(P.prompt_context("question", "ctx")).alias("prompt"))


@register("prompt_chat",
          "WITH h AS (SELECT conv_id, turn, role, list(CASE WHEN length(" + O.strip("coalesce(text, '')") + ") > 0 THEN "
          "'[' || upper(coalesce(role, 'user')) || ']' || chr(10) || coalesce(text, '') END) OVER (PARTITION BY conv_id ORDER BY turn "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS msgs FROM conversations) "
          f"SELECT conv_id, turn, '[SYSTEM]' || chr(10) || {O.lit(P.CODE_SYSTEM_PROMPT)} || "
          "coalesce(chr(10) || chr(10) || array_to_string(list_filter(msgs, lambda m: m IS NOT NULL), chr(10) || chr(10)), '') "
          f"|| chr(10) || chr(10) || {O.lit(P.FLAT_ASSISTANT)} AS prompt FROM h WHERE coalesce(role, 'user') = 'user'")
def q_prompt_chat(spark, sf):
    """D5 + D6 at every user turn of every conversation."""
    p = H.chat_prompts(table(spark, sf, "conversations"))
    return p.select("conv_id", "turn", P.render_flat("prompt").alias("prompt"))


# --- I: default generator -----------------------------------------------------------

@register("extractive_answer", GATED + f", acc AS (SELECT qid, question, ctx FROM judged WHERE ok), {O.extractive_ctes('acc')} "
          "SELECT qid, raw FROM picked")
def q_extractive_answer(spark, sf):
    """Best-overlap context sentence for every accepted question."""
    j = _judged(spark, sf).filter("ok")
    return j.select("qid", extractive_answer(F.col("question"), F.col("ctx")).alias("raw"))


# --- J: evaluation ------------------------------------------------------------------

EV_SQL = ("SELECT event_id, event_type, CAST(length(coalesce(props, '')) AS BIGINT) AS tokens, value / 10.0 AS seconds, "
          "CAST(user_id % 13 AS BIGINT) AS tokens2, value / 40.0 AS seconds2 FROM events")


def _events(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "event_type", F.length(F.coalesce("props", F.lit(""))).cast("long").alias("tokens"),
                    (F.col("value") / 10.0).alias("seconds"), (F.col("user_id") % 13).cast("long").alias("tokens2"),
                    (F.col("value") / 40.0).alias("seconds2"))


def tok_rate(tokens, seconds):
    """J1 per query: tokens / max(seconds, 1e-6)."""
    return tokens / F.greatest(seconds, F.lit(1e-6))


def tok_rate_batch(tokens, seconds):
    """J1 batch form: 0 when the time is not positive."""
    return F.when(seconds <= 1e-6, F.lit(0.0)).otherwise(tokens / seconds)


@register("throughput",
          f"SELECT event_id, round(tokens / greatest(seconds, 1e-6), 6) AS tok_s, "
          f"round(CASE WHEN seconds <= 1e-6 THEN 0.0 ELSE tokens / seconds END, 6) AS tok_s_batch FROM ({EV_SQL})")
def q_throughput(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", F.round(tok_rate(F.col("tokens"), F.col("seconds")), 6).alias("tok_s"),
                    F.round(tok_rate_batch(F.col("tokens"), F.col("seconds")), 6).alias("tok_s_batch"))


@register("retry_accounting",
          f"SELECT event_id, tokens + tokens2 AS tokens, round(seconds + seconds2, 6) AS seconds, "
          f"round(CASE WHEN seconds + seconds2 <= 1e-6 THEN 0.0 ELSE (tokens + tokens2) / (seconds + seconds2) END, 6) AS tok_s FROM ({EV_SQL})")
def q_retry_accounting(spark, sf):
    """Both passes' tokens and time summed, rate recomputed."""
    e = _events(spark, sf)
    t = F.col("tokens") + F.col("tokens2")
    s = F.col("seconds") + F.col("seconds2")
    return e.select("event_id", t.alias("tokens"), F.round(s, 6).alias("seconds"), F.round(tok_rate_batch(t, s), 6).alias("tok_s"))


@register("run_summary",
          f"SELECT event_type, round(coalesce(avg(tokens / greatest(seconds, 1e-6)), 0.0), 2) AS avg_tok_s, "
          f"round(coalesce(avg(seconds), 0.0), 2) AS avg_time_s, count(*) AS n FROM ({EV_SQL}) GROUP BY event_type")
def q_run_summary(spark, sf):
    """Mean rate, mean time and count per group (0.0 when empty)."""
    e = _events(spark, sf)
    return e.groupBy("event_type").agg(
        F.round(F.coalesce(F.avg(tok_rate(F.col("tokens"), F.col("seconds"))), F.lit(0.0)), 2).alias("avg_tok_s"),
        F.round(F.coalesce(F.avg("seconds"), F.lit(0.0)), 2).alias("avg_time_s"),
        F.count(F.lit(1)).alias("n"))


@register("result_table",
          O.flagship(tail="__T__").replace(") __T__", ") SELECT q.qid + 1 AS ordinal, length(coalesce(a.answer, " + O.REFUSE + ")) AS chars, "
                                           + O.ellipsize("q.question", 120) + " AS question, coalesce(a.answer, " + O.REFUSE + ") AS answer "
                                           "FROM routed q LEFT JOIN allr a ON q.qid = a.qid", 1))
def q_result_table(spark, sf):
    """1-based ordinal, answer length, ellipsised question, answer."""
    a = q_answer_questions(spark, sf)
    return a.select((F.col("qid") + 1).alias("ordinal"), F.length("answer").cast("long").alias("chars"),
                    T.ellipsize("question", 120).alias("question"), "answer")


@register("preview", f"WITH {O.benchmark_questions_cte()} SELECT qid, question FROM qs ORDER BY qid LIMIT 5")
def q_preview(spark, sf):
    """First five questions (the limit is the feature)."""
    return bench_questions(spark, sf).orderBy("qid").limit(5)


@register("corpus_counts",
          f"WITH {O.documents_cte()}, {O.chunks_cte()}, {O.vectors_cte('cvec', 'chunks', 'doc_id, pos', 'text')}, {O.benchmark_questions_cte()} "
          "SELECT 'documents' AS item, count(*) AS n FROM docs UNION ALL SELECT 'chunks', count(*) FROM chunks "
          "UNION ALL SELECT 'vectors', count(*) FROM (SELECT DISTINCT doc_id, pos FROM cvec) "
          "UNION ALL SELECT 'questions', count(*) FROM qs UNION ALL SELECT 'answers', count(*) FROM qs")
def q_corpus_counts(spark, sf):
    """Documents, chunks, vectors, questions, answers (answers are 1:1 with questions by G5)."""
    docs = prepared_docs(spark, sf)
    c = build_corpus(docs)
    qs = bench_questions(spark, sf)
    parts = [
        docs.select(F.lit("documents").alias("item"), F.lit(1).alias("one")),
        c.chunks.select(F.lit("chunks").alias("item"), F.lit(1).alias("one")),
        c.vectors.select("doc_id", "pos").distinct().select(F.lit("vectors").alias("item"), F.lit(1).alias("one")),
        qs.select(F.lit("questions").alias("item"), F.lit(1).alias("one")),
        answer_questions(qs, c).filter("answer IS NOT NULL").select(F.lit("answers").alias("item"), F.lit(1).alias("one")),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("item").agg(F.count(F.lit(1)).alias("n"))


# --- A: sources and sinks (write driver tables to the shared scratch folder, read back) --

from ..session import scratch_path  # noqa: E402
from ..sources import readers as RD  # noqa: E402
from ..sources import chunk_store as CS  # noqa: E402
from ..sources import sinks as SK  # noqa: E402


def _files(spark):
    """Part files of the file queries: as many as the session has shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _padded():
    return F.concat(F.lit("  "), F.col("item_id").cast("string"), F.lit(" ")).alias("answer")


def _bench_q(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _write_json_documents(rows, key, order, item, path, each):
    """One JSON document ``{key: [...]}`` for every ``each`` ids, one file a document, files in id order."""
    block = F.format_string("%012d", F.floor(F.col(order) / each))
    docs = rows.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(order, item.alias("j")))).alias("xs"))
    docs = docs.select("block", F.concat(F.lit('{"%s": [' % key), F.array_join(F.transform("xs", lambda x: x["j"]), ", "),
                                         F.lit("]}")).alias("value"))
    docs.write.mode("overwrite").partitionBy("block").text(path)


def _write_delim(df, path, sep, order):
    # a range sort: part files in name order hold the rows in order
    (df.repartitionByRange(_files(df.sparkSession), order).sortWithinPartitions(order).drop(order).write.mode("overwrite").option("header", True)
     .option("escape", '"').options(**SK.KEEP_BLANKS).option("sep", sep).csv(path))


Q_ORDER_SQL = f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS qid, {O.strip('text')} AS question FROM benchmark"


@register("src_questions_csv", f"SELECT * FROM ({Q_ORDER_SQL}) WHERE length(question) > 0")
def q_src_questions_csv(spark, sf):
    """A2 + A8: CSV with a ``question`` column, read back in file order."""
    path = scratch_path(spark, "questions-csv")
    _write_delim(_bench_q(spark, sf).select("question", "qid"), path, ",", "qid")
    return RD.read_questions(spark, path, "csv")


@register("src_questions_tsv", f"SELECT * FROM ({Q_ORDER_SQL}) WHERE length(question) > 0")
def q_src_questions_tsv(spark, sf):
    """A3 + A8: TSV whose first column is the question (no ``question`` column)."""
    path = scratch_path(spark, "questions-tsv")
    _write_delim(_bench_q(spark, sf).select(F.col("question").alias("q"), "qid"), path, "\t", "qid")
    return RD.read_questions(spark, path, "tsv")


@register("src_questions_txt",
          f"WITH l AS (SELECT item_id, unnest(string_split_regex(text, {O.rx(T.LINE_BREAK)})) AS line, "
          f"unnest(range(1, len(string_split_regex(text, {O.rx(T.LINE_BREAK)})) + 1)) AS i FROM benchmark), "
          f"s AS (SELECT item_id, i, {O.strip('line')} AS question FROM l) "
          "SELECT row_number() OVER (ORDER BY item_id, i) - 1 AS qid, question FROM s WHERE length(question) > 0")
def q_src_questions_txt(spark, sf):
    """A4: plain text, one stripped non-blank line per question (benchmark texts written line by line)."""
    path = scratch_path(spark, "questions-txt")
    b = table(spark, sf, "benchmark")
    lines = b.select("item_id", F.posexplode(F.split("text", T.LINE_BREAK)).alias("i", "line"))
    lines.repartitionByRange(_files(spark), "item_id", "i").sortWithinPartitions("item_id", "i").select("line").write.mode("overwrite").text(path)
    return RD.read_questions(spark, path, "txt")


@register("src_questions_json",
          f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS qid, {O.strip('text')} AS question FROM benchmark WHERE length({O.strip('text')}) > 0")
def q_src_questions_json(spark, sf):
    """A1: one JSON document ``{"questions": [ {"question": ...}, "...", ... ]}`` (objects and strings mixed)."""
    path = scratch_path(spark, "questions-json")
    b = table(spark, sf, "benchmark")
    as_string = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("x"))), r'^\{"x":(.*)\}$', 1)
    item = F.when(F.col("item_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("question")))).otherwise(as_string)
    _write_json_documents(b, "questions", "item_id", item, path, 16)
    return RD.read_questions(spark, path, "json")


DOCS_ORDER_SQL = (f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, {O.strip(chr(39) * 2 + ' || coalesce(source, ' + chr(39) * 2 + ')')} AS title, "
                  f"{O.strip(chr(39) * 2 + ' || coalesce(text, ' + chr(39) * 2 + ')')} AS text FROM documents")


@register("src_documents_csv", f"SELECT * FROM ({DOCS_ORDER_SQL}) WHERE length(text) > 0")
def q_src_documents_csv(spark, sf):
    """CSV with ``text`` and ``title`` columns (multi-line fields quoted)."""
    path = scratch_path(spark, "documents-csv")
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), "text")
    _write_delim(d, path, ",", "doc_id")
    return RD.read_documents(spark, path, "csv")


@register("src_documents_tsv", f"SELECT doc_id, '' AS title, text FROM ({DOCS_ORDER_SQL}) WHERE length(text) > 0")
def q_src_documents_tsv(spark, sf):
    """A6 + A8: TSV without ``text``/``title`` columns: first column is the text, title ''."""
    path = scratch_path(spark, "documents-tsv")
    d = table(spark, sf, "documents").select(F.col("text").alias("body"), "doc_id")
    _write_delim(d, path, "\t", "doc_id")
    return RD.read_documents(spark, path, "tsv")


@register("src_documents_json", f"SELECT * FROM ({DOCS_ORDER_SQL}) WHERE length(text) > 0")
def q_src_documents_json(spark, sf):
    """A5: ``{"items": [ {"title", "text"}, ... ]}``."""
    path = scratch_path(spark, "documents-json")
    d = table(spark, sf, "documents")
    item = F.to_json(F.struct(F.col("source").alias("title"), "text"))
    _write_json_documents(d, "items", "doc_id", item, path, 250)
    return RD.read_documents(spark, path, "json")


@register("src_documents_jsonl", f"SELECT * FROM ({DOCS_ORDER_SQL}) WHERE length(text) > 0")
def q_src_documents_jsonl(spark, sf):
    """A5 for large inputs: JSON Lines, split and read in parallel."""
    path = scratch_path(spark, "documents-jsonl")
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("title"), "text")
    d.repartitionByRange(_files(spark), "doc_id").sortWithinPartitions("doc_id").select("title", "text").write.json(path)
    return RD.read_documents(spark, path, "jsonl")


@register("src_documents_txt",
          f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS doc_id, '' AS title, {O.strip('text')} AS text FROM benchmark WHERE length({O.strip('text')}) > 0")
def q_src_documents_txt(spark, sf):
    """Whole files as documents, one file a benchmark text."""
    path = scratch_path(spark, "documents-txt")
    b = table(spark, sf, "benchmark").select(F.format_string("%020d", F.col("item_id").cast("long")).alias("item"), "text")
    b.repartition(_files(spark), "item").write.partitionBy("item").text(path)
    return RD.read_documents(spark, path, "txt").select("doc_id", "title", "text")


@register("src_documents_by_suffix",
          f"WITH d AS (SELECT * FROM ({DOCS_ORDER_SQL}) WHERE length(text) > 0) SELECT 'csv' AS fmt, * FROM d UNION ALL SELECT 'tsv', * FROM d UNION ALL SELECT 'jsonl', * FROM d")
def q_src_documents_by_suffix(spark, sf):
    """The reader is chosen by the path's suffix alone."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), "text")
    found = None
    for fmt in ("csv", "tsv", "jsonl"):
        path = f"{scratch_path(spark, 'documents')}.{fmt}"
        if fmt == "jsonl":
            d.repartitionByRange(_files(spark), "doc_id").sortWithinPartitions("doc_id").select(F.coalesce("title", F.lit("")).alias("title"), "text").write.json(path)
        else:
            _write_delim(d, path, {"csv": ",", "tsv": "\t"}[fmt], "doc_id")
        got = RD.read_documents(spark, path).select(F.lit(fmt).alias("fmt"), "doc_id", "title", "text")
        found = got if found is None else found.unionByName(got)
    return found


@register("adapt_dataset_limit",
          f"SELECT doc_id, {O.strip('text')} AS text FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100)")
def q_adapt_dataset_limit(spark, sf):
    """A11 with a limit (the feature itself): the first 100 rows in id order."""
    d = RD.adapt_dataset(table(spark, sf, "documents"), "text", order_by="doc_id", limit=100)
    return d.select("doc_id", T.strip("text").alias("text"))


@register("sink_dataset", "SELECT row_number() OVER (ORDER BY page_id) - 1 AS doc_id, '' AS title, "
          f"{O.strip("CASE WHEN length(url) > 10 THEN url WHEN length(html) > 10 THEN html END")} AS text FROM pages")
def q_sink_dataset(spark, sf):
    """The adapted dataset written as JSON Lines and read back as documents."""
    path = scratch_path(spark, "dataset")
    pages = RD.adapt_dataset(table(spark, sf, "pages"), "text", None, order_by="page_id")
    SK.write_dataset(pages.repartitionByRange(_files(spark), "page_id").sortWithinPartitions("page_id"), path, "json")
    return RD.read_documents(spark, path, "jsonl")


@register("strip_bom", f"SELECT doc_id, {O.strip(DOC_TEXT)} AS text FROM documents")
def q_strip_bom(spark, sf):
    """A10: a leading BOM goes from every document text."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit(RD.BOM), F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", T.strip(RD.strip_bom("t")).alias("text"))


@register("adapt_dataset",
          "SELECT page_id, CASE WHEN length(url) > 10 THEN url WHEN length(html) > 10 THEN html END AS text, '' AS title FROM pages")
def q_adapt_dataset(spark, sf):
    """Pages have no ``text`` column: first string value longer than 10 characters per row."""
    return RD.adapt_dataset(table(spark, sf, "pages"), "text", None, order_by="page_id")


@register("sink_answers_csv", Q_ORDER_SQL.replace("SELECT row_number() OVER (ORDER BY item_id) - 1 AS qid, ", "SELECT ") .replace(" AS question FROM", " AS question, '  ' || CAST(item_id AS VARCHAR) || ' ' AS answer FROM"))
def q_sink_answers_csv(spark, sf):
    """Answers CSV (header, no index) read back; the answers are padded with blanks, which must survive."""
    path = scratch_path(spark, "answers-csv")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), T.strip("text").alias("question"), _padded())
    SK.write_answers(b, path, "csv")
    return _read_back_pairs(spark, path, ",")


def _read_back_pairs(spark, path, sep):
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(path))
    return df.select("question", "answer")


@register("sink_answers_tsv", Q_ORDER_SQL.replace("SELECT row_number() OVER (ORDER BY item_id) - 1 AS qid, ", "SELECT ") .replace(" AS question FROM", " AS question, '  ' || CAST(item_id AS VARCHAR) || ' ' AS answer FROM"))
def q_sink_answers_tsv(spark, sf):
    """Answers TSV read back."""
    path = scratch_path(spark, "answers-tsv")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), T.strip("text").alias("question"), _padded())
    SK.write_answers(b, path, "tsv")
    return _read_back_pairs(spark, path, "\t")


@register("sink_answers_json_pairs", f"SELECT item_id AS qid, text AS question, {O.ellipsize('text', 40)} AS answer FROM benchmark")
def q_sink_answers_json_pairs(spark, sf):
    """``{question, answer}`` JSON Lines in question order, read back."""
    path = scratch_path(spark, "answers-json-pairs")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), T.ellipsize("text", 40).alias("answer"))
    SK.write_answers(b, path, "json_pairs")
    return spark.read.schema("qid long, question string, answer string").json(path)


@register("sink_answers_json",
          f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS qid, {O.strip(O.ellipsize('text', 40))} AS question FROM benchmark "
          f"WHERE length({O.strip(O.ellipsize('text', 40))}) > 0")
def q_sink_answers_json(spark, sf):
    """A17 exact form: one JSON array of answers in question order, written in parts and read back in parallel."""
    path = scratch_path(spark, "answers-json")
    SK.write_answers_document(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), T.ellipsize("text", 40).alias("answer")), path)
    return RD.read_questions(spark, path, "json_parts")


@register("sink_dataset_items", f"SELECT * FROM ({DOCS_ORDER_SQL}) WHERE length(text) > 0")
def q_sink_dataset_items(spark, sf):
    """A12 exact form: the adapted documents as one ``{"items": [...]}``, read back as documents (A5)."""
    path = scratch_path(spark, "dataset-items")
    SK.write_dataset_document(RD.adapt_dataset(table(spark, sf, "documents"), "text", "source", order_by="doc_id"), path, "doc_id")
    return RD.read_documents(spark, path, "json_parts")


@register("chunk_store_roundtrip", f"WITH {O.documents_cte()}, {O.chunks_cte()} SELECT doc_id, pos, title, text FROM chunks")
def q_chunk_store_roundtrip(spark, sf):
    """Chunk store written as Parquet and read back with the chunk key."""
    path = scratch_path(spark, "chunk-store")
    CS.write_chunk_store(CH.chunk_documents(prepared_docs(spark, sf)), path)
    return CS.ChunkStore(spark, path).rows().select("doc_id", "pos", "title", "text")


@register("vector_store_roundtrip", f"WITH {O.documents_cte()}, {O.chunks_cte()}, {O.vectors_cte('cvec', 'chunks', 'doc_id, pos', 'text')} "
          "SELECT doc_id, pos, term, round(w, 9) AS w FROM cvec")
def q_vector_store_roundtrip(spark, sf):
    """Vector store (one row per chunk, term/weight arrays) written and read back to long form."""
    path = scratch_path(spark, "vector-store")
    SK.write_vector_store(corpus_of(spark, sf).vectors, path)
    return SK.read_vector_store(spark, path).select("doc_id", "pos", "term", F.round("w", 9).alias("w"))


@register("index_meta", f"WITH {O.documents_cte()}, {O.chunks_cte()}, {O.vectors_cte('cvec', 'chunks', 'doc_id, pos', 'text')} "
          "SELECT 'terms' AS model, (SELECT count(DISTINCT term) FROM cvec) AS dim, (SELECT count(*) FROM chunks) AS chunks, "
          "700 AS chunk_size, 120 AS chunk_overlap")
def q_index_meta(spark, sf):
    """Index metadata of the default term encoder, written and read back."""
    path = scratch_path(spark, "index-meta")
    c = corpus_of(spark, sf)
    SK.index_meta(c.chunks, c.vectors, "terms", CH.CHUNK_SIZE, CH.CHUNK_OVERLAP).write.json(path)
    return spark.read.schema(SK.META_SCHEMA).json(path)


@register("qa_alignment", "SELECT 0 AS missing_answers, 0 AS missing_questions, (SELECT count(*) FROM benchmark) AS pairs, true AS ok")
def q_qa_alignment(spark, sf):
    """Questions and flagship answers pair up 1:1 (the job fails otherwise)."""
    qs = table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("qid"))
    ans = q_answer_questions(spark, sf)
    return SK.check_alignment(qs, ans)


# --- I/F2: user-model surfaces (rows-only checks) ------------------------------------

PLAIN_SQL = _flat_sql(("user", "question"))


@register("generate_batch",
          f"WITH {O.benchmark_questions_cte()}, p AS (SELECT qid, {PLAIN_SQL} AS prompt FROM qs), "
          f"l AS (SELECT qid, prompt, list_filter(string_split(prompt, chr(10)), lambda x: length({O.strip('x')}) > 0 AND NOT starts_with(x, '[')) AS lines FROM p), "
          "r AS (SELECT qid, coalesce(lines[-1], '') AS raw FROM l) "
          f"SELECT qid, raw, CAST(len(regexp_extract_all(raw, '[^{T.WS_BODY}]+')) AS BIGINT) AS tokens FROM r")
def q_generate_batch(spark, sf):
    """Fixed-size batched generation with a user model (a deterministic echo model here)."""
    from ..operators.inference import PROFILE_PLAIN, generate_batch
    from ..operators.toy_models import make_echo_generator

    b = bench_questions(spark, sf).withColumn("prompt", P.render_flat(P.prompt_plain("question")))
    return generate_batch(b, "prompt", make_echo_generator, PROFILE_PLAIN, "gen", 8).select("qid", F.col("gen.text").alias("raw"), F.col("gen.tokens").alias("tokens"))


# One token adds 1 to the bucket of its shape (see make_shape_encoder).
SHAPE_SQL = "(7 * unicode(form) + 3 * unicode(right(form, 1)) + length(form)) % 64"


@register("encode_batch",
          f"WITH {O.documents_cte()}, {O.chunks_cte()}, {O.vectors_cte('cvec', 'chunks', 'doc_id, pos', 'text', SHAPE_SQL)}, "
          "n AS (SELECT doc_id, pos, unnest(range(0, 64)) AS i FROM chunks) "
          "SELECT n.doc_id, n.pos, n.i, round(coalesce(c.w, 0.0), 9) AS x FROM n LEFT JOIN cvec c ON c.doc_id = n.doc_id AND c.pos = n.pos AND c.term = n.i")
def q_encode_batch(spark, sf):
    """F2 with a user encoder: batch-64 unit vectors of every chunk's normalised text, one row a component."""
    from ..operators.inference import encode_batch
    from ..operators.toy_models import make_shape_encoder

    ch = CH.chunk_documents(prepared_docs(spark, sf)).select("doc_id", "pos", V.normalize_lemma("text").alias("norm"))
    found = encode_batch(ch, "norm", make_shape_encoder).select("doc_id", "pos", F.posexplode("embedding").alias("i", "x"))
    return found.select("doc_id", "pos", F.col("i").cast("long").alias("i"), F.round("x", 9).alias("x"))


@register("answer_questions_dense", O.flagship(term=SHAPE_SQL, every=True))
def q_answer_questions_dense(spark, sf):
    """F2 to F10 with a user encoder: a dense index stored from the documents, opened again and asked."""
    from ..operators.toy_models import make_shape_encoder
    from .answer import open_dense_corpus, store_dense_corpus

    path = scratch_path(spark, "dense-index")
    store_dense_corpus(prepared_docs(spark, sf), path, make_shape_encoder, "shapes")
    return answer_questions(bench_questions(spark, sf), open_dense_corpus(spark, path, make_shape_encoder))


STEM_SQL = "CASE WHEN length(form) >= 8 THEN substring(form, 1, 6) ELSE form END"


@register("answer_questions_lemma", O.flagship(term=STEM_SQL))
def q_answer_questions_lemma(spark, sf):
    """B3/B5 in retrieval: corpus and questions over the lemmas of one memo, learnt from their distinct tokens."""
    from ..operators.lemmas import Lemmas
    from ..operators.toy_models import make_stem_lemmatiser

    lemmas = Lemmas(scratch_path(spark, "memo"), make_stem_lemmatiser)
    return answer_questions(bench_questions(spark, sf), build_corpus(prepared_docs(spark, sf), lemmas=lemmas))


@register("answer_questions_dense_lemma", O.flagship(term=SHAPE_SQL.replace("form", f"({STEM_SQL})"), every=True))
def q_answer_questions_dense_lemma(spark, sf):
    """The user encoder over lemmatised texts, on both sides."""
    from ..operators.lemmas import Lemmas
    from ..operators.toy_models import make_shape_encoder, make_stem_lemmatiser
    from .answer import open_dense_corpus, store_dense_corpus

    path, lemmas = scratch_path(spark, "dense-index"), Lemmas(scratch_path(spark, "memo"), make_stem_lemmatiser)
    store_dense_corpus(prepared_docs(spark, sf), path, make_shape_encoder, "shapes", lemmas=lemmas)
    return answer_questions(bench_questions(spark, sf), open_dense_corpus(spark, path, make_shape_encoder, lemmas=lemmas))


@register("answer_questions_stored", O.flagship())
def q_answer_questions_stored(spark, sf):
    """The term index stored, opened and asked; texts are fetched from the ranges that hold wanted keys."""
    from .answer import open_corpus, store_corpus

    path = scratch_path(spark, "term-index")
    store_corpus(corpus_of(spark, sf), path)
    return answer_questions(bench_questions(spark, sf), open_corpus(spark, path))


# make_careless_generator and make_careful_generator, restated over the two passes of the plain route
STRICT_SQL = _flat_sql(("system", O.lit(P.STRICT_PROMPT)), ("user", "question"))
RETRY_CTES = (
    f"qs AS ({MIXED_Q_SQL}), routed AS ({O.math_select('qs', 'question', 'math')}), "
    f"p1 AS (SELECT qid, question, {PLAIN_SQL} AS prompt FROM routed WHERE math IS NULL), "
    f"g1 AS (SELECT qid, question, CASE WHEN length(prompt) % 2 = 0 THEN 'ответ' ELSE 'ответ номер ' || ({_seed_sql('prompt')} % 1000) || ' готов' END AS raw FROM p1), "
    f"c1 AS ({O.clean_answer('(' + O.clean_raw_output('g1', 'raw', 'question', 'raw1') + ')', 'raw1', 'question', 'ans1')}), "
    f"b1 AS (SELECT qid, question, length(raw) AS t1, ans1, {O.is_broken('ans1')} AS bad FROM c1), "
    f"p2 AS (SELECT qid, question, t1, {STRICT_SQL} AS prompt FROM b1 WHERE bad), "
    "g2 AS (SELECT qid, question, t1, CASE WHEN length(prompt) % 3 <> 0 THEN 'строгий ответ до 48 слов' ELSE 'слово' END AS raw FROM p2), "
    f"c2 AS ({O.clean_answer('(' + O.clean_raw_output('g2', 'raw', 'question', 'raw2') + ')', 'raw2', 'question', 'ans2')}), "
    f"run AS (SELECT qid, question, math AS answer, 'math' AS route, false AS retried, 0 AS calls, 0 AS tokens FROM routed WHERE math IS NOT NULL "
    "UNION ALL SELECT qid, question, ans1, 'plain', false, 1, t1 FROM b1 WHERE NOT bad "
    f"UNION ALL SELECT qid, question, CASE WHEN {O.is_broken('ans2')} THEN {O.REFUSE} ELSE ans2 END, 'plain', true, 2, t1 + length(raw) FROM c2)"
)


def _retry_run(spark, sf):
    from ..operators.inference import Generators
    from ..operators.toy_models import make_careful_generator, make_careless_generator
    from .answer import run_questions

    gens = Generators(plain=make_careless_generator, strict=make_careful_generator)
    return run_questions(mixed_questions(spark, sf), None, Options(use_index=False), gens)


@register("strict_retry", f"WITH {RETRY_CTES} SELECT * FROM run")
def q_strict_retry(spark, sf):
    """G6 + J2 with user models: plain generation, broken answers alone generated again with the strict prompt; calls are counted."""
    return _retry_run(spark, sf).drop("best_score", "seconds")


@register("run_summary_answers",
          f"WITH {RETRY_CTES} SELECT count(*) AS n, count(*) FILTER (retried) AS retried, CAST(sum(calls) AS BIGINT) AS calls, "
          "CAST(sum(tokens) AS BIGINT) AS tokens, true AS timed FROM run")
def q_run_summary_answers(spark, sf):
    """J1-J3 over a run: counts, calls and tokens of both passes; times differ from run to run, so only that they are there is told."""
    from .answer import run_summary

    found = run_summary(written(_retry_run(spark, sf), "run"))
    return found.select("n", "retried", "calls", "tokens", ((F.col("avg_time_s") >= 0) & (F.col("avg_tok_s") > 0)).alias("timed"))
