"""Deterministic arithmetic answers (survey §2.3) as Column expressions.

Rules are tried in order and the first one that yields a value wins, which is
exactly ``coalesce``.  Spark 4 runs ANSI SQL, so empty regex captures become
NULL before any cast, divisions use ``try_divide`` and ordinal words go through
a literal map.  Digits are ASCII ``[0-9]`` (Python's ``\\d`` would also accept
other Unicode decimal digits; see README, deviations).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import REFUSE, WS, strip

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------
ORDINAL_POWERS = {
    "второй": 2, "третьей": 3, "четвёртой": 4, "четвертой": 4, "пятой": 5,
    "шестой": 6, "седьмой": 7, "восьмой": 8, "девятой": 9, "десятой": 10,
}
DEFAULT_PI = 3.1415926535
OPS_PLUS = ["плюс", "+"]
OPS_MINUS = ["минус", "-"]
OPS_TIMES = ["умножить на", "*", "x", "×"]
OPS_DIV = ["разделить на", "/", ":"]
# ---------------------------------------------------------------------------

S = f"{WS}"
D = "([0-9]+)"
RE_BINARY = f"сколько{S}+будет{S}+{D}{S}*(плюс|минус|умножить{S}+на|разделить{S}+на|/|:|\\*|x|×|\\+|-){S}*{D}"
RE_DIVIDE = f"{D}{S}*(разделить{S}+на|/|:){S}*{D}"
RE_MULTIPLY = f"{D}{S}*(умножить{S}+на|\\*|x|×){S}*{D}"
RE_SUM = f"сумма{S}+чисел{S}+{D}{S}*и{S}*{D}"
RE_PERCENT = f"{D}{S}*процент(?:а|ов)?{S}*от{S}*{D}"
RE_MEAN = f"среднее{S}+арифметическое{S}+чисел{S}+([0-9,{WS[1:-1]}]+)"
RE_SQRT = f"квадратн[а-яё]*{S}+корень{S}+из{S}+{D}"
RE_POWER = f"{D}{S}+в{S}+([а-яё]+){S}+степени"
RE_CIRCLE = f"площадь{S}+круга{S}+радиуса{S}+([0-9]+(?:[.,][0-9]+)?)"
RE_PI = f"π{S}*={S}*([0-9]+(?:[.,][0-9]+)?)"


def _group(q: Column, pattern: str, idx: int) -> Column:
    g = F.regexp_extract(q, pattern, idx)
    return F.when(F.length(g) > 0, g)


def _num(s: Column) -> Column:
    return F.regexp_replace(s, ",", ".").try_cast("double")


def format_number_ru(v) -> Column:
    """C11: integer-like -> ``N.``; else ``%.10g`` with trailing zeros dropped, ``,`` decimal, final ``.``."""
    v = F.col(v) if isinstance(v, str) else v
    r = F.round(v)
    intlike = F.abs(v - r) < F.lit(1e-9)
    # exact below 2**63; beyond that Java prints the shortest repr padded with zeros
    as_int = F.when(F.abs(r) < F.lit(9.0e18), r.cast("long").cast("string")).otherwise(F.format_string("%.0f", r))
    g = F.format_string("%.10g", v)
    # Java keeps trailing zeros in %g; Python drops them.
    g = F.regexp_replace(g, r"(\.[0-9]*?)0+(e|$)", "$1$2")
    g = F.regexp_replace(g, r"\.(e|$)", "$1")
    g = F.regexp_replace(g, r"\.", ",")
    return F.when(v.isNull(), F.lit(None).cast("string")).when(
        intlike, F.concat(as_int, F.lit("."))
    ).otherwise(F.concat(g, F.lit(".")))


def _fire(value: Column, refuse: Column | None = None) -> Column:
    """A rule result: NULL when the rule does not answer, else ``(refuse, value)``."""
    refuse = F.lit(False) if refuse is None else refuse
    return F.struct(refuse.alias("refuse"), value.cast("double").alias("value"))


def _binary(q: Column) -> Column:
    a = _num(_group(q, RE_BINARY, 1))
    op = _group(q, RE_BINARY, 2)
    b = _num(_group(q, RE_BINARY, 3))
    return (
        F.when(op.isin(*OPS_PLUS), _fire(a + b))
        .when(op.isin(*OPS_MINUS), _fire(a - b))
        .when(op.isin(*OPS_TIMES), _fire(a * b))
        .when(op.isin(*OPS_DIV) & (b == 0), _fire(F.lit(None), F.lit(True)))
        .when(op.isin(*OPS_DIV), _fire(F.try_divide(a, b)))
    )


def _divide(q: Column) -> Column:
    a = _num(_group(q, RE_DIVIDE, 1))
    b = _num(_group(q, RE_DIVIDE, 3))
    return F.when(b == 0, _fire(F.lit(None), F.lit(True))).when(b.isNotNull(), _fire(F.try_divide(a, b)))


def _multiply(q: Column) -> Column:
    a = _num(_group(q, RE_MULTIPLY, 1))
    b = _num(_group(q, RE_MULTIPLY, 3))
    return F.when(b.isNotNull(), _fire(a * b))


def _sum(q: Column) -> Column:
    b = _num(_group(q, RE_SUM, 2))
    return F.when(b.isNotNull(), _fire(_num(_group(q, RE_SUM, 1)) + b))


def _percent(q: Column) -> Column:
    p = _num(_group(q, RE_PERCENT, 1))
    base = _num(_group(q, RE_PERCENT, 2))
    return F.when(base.isNotNull(), _fire(base * p / F.lit(100.0)))


def _mean(q: Column) -> Column:
    body = _group(q, RE_MEAN, 1)
    nums = F.transform(F.regexp_extract_all(body, F.lit("([0-9]+)"), 1), lambda x: x.try_cast("double"))
    total = F.aggregate(nums, F.lit(0.0), lambda acc, x: acc + x)
    n = F.size(nums)
    return F.when(body.isNotNull() & (n > 0), _fire(total / n))


def _sqrt(q: Column) -> Column:
    n = _group(q, RE_SQRT, 1).try_cast("long")
    r = F.round(F.sqrt(n.cast("double"))).cast("long")
    exact = F.try_multiply(r, r) == n
    return F.when(n.isNotNull(), F.when(exact, _fire(r)).otherwise(_fire(F.lit(None), F.lit(True))))


def _power(q: Column) -> Column:
    base = _num(_group(q, RE_POWER, 1))
    word = _group(q, RE_POWER, 2)
    ords = F.create_map(*[x for k, v in ORDINAL_POWERS.items() for x in (F.lit(k), F.lit(v))])
    exp = F.try_element_at(ords, word)
    return F.when(exp.isNotNull(), _fire(F.pow(base, exp.cast("double"))))


def _circle(q: Column) -> Column:
    r = _num(_group(q, RE_CIRCLE, 1))
    pi = F.coalesce(_num(_group(q, RE_PI, 1)), F.lit(DEFAULT_PI))
    return F.when(r.isNotNull(), _fire(pi * (r * r)))


RULES = {
    "math_binary": _binary,
    "math_divide": _divide,
    "math_multiply": _multiply,
    "math_sum": _sum,
    "math_percent": _percent,
    "math_mean": _mean,
    "math_sqrt": _sqrt,
    "math_power": _power,
    "math_circle": _circle,
}


def render(result) -> Column:
    """Rule result struct -> answer text (REFUSE, formatted number, or NULL)."""
    r = F.col(result) if isinstance(result, str) else result
    return F.when(r.isNull(), F.lit(None).cast("string")).when(r["refuse"], F.lit(REFUSE)).otherwise(
        format_number_ru(r["value"])
    )


def math_question(col) -> Column:
    """Canonical rule input: lower(strip(question))."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(strip(c))


def math_answer(col) -> Column:
    """C12 as one Column (small inputs); plans use ``with_math_answer``."""
    q = math_question(col)
    return render(F.coalesce(*[rule(q) for rule in RULES.values()]))


def with_rule(df: DataFrame, question: str, rule: str, out: str) -> DataFrame:
    """One rule alone (C1-C10 keys): its answer, or NULL when it does not fire."""
    tmp, res = "__mq", "__mr"
    df = df.withColumn(tmp, math_question(question))
    df = df.withColumn(res, RULES[rule](F.col(tmp)))
    return df.withColumn(out, render(F.col(res))).drop(tmp, res)


def with_math_answer(df: DataFrame, question: str, out: str = "math_answer") -> DataFrame:
    """Rules in order, first that fires wins; the lowered question and the
    chosen result are projected once so the number is formatted once."""
    tmp, res = "__mq", "__mr"
    df = df.withColumn(tmp, math_question(question))
    df = df.withColumn(res, F.coalesce(*[rule(F.col(tmp)) for rule in RULES.values()]))
    return df.withColumn(out, render(F.col(res))).drop(tmp, res)
