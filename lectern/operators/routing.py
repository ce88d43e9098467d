"""Score gate, rejection reasons, answer fallback and merge (survey G1-G8)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import REFUSE, is_broken, strip

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------
THRESHOLD = 0.38
# ---------------------------------------------------------------------------


def best_score(col="best_score") -> Column:
    """G1: best score, 0.0 when the question has none."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(0.0))


def gate(best="best_score", ctx="ctx", threshold: float = THRESHOLD) -> Column:
    """Accept iff scores exist, best >= threshold (equality accepts) and the context is not blank."""
    b = F.col(best)
    return (
        b.isNotNull()
        & (b >= F.lit(threshold))
        & (F.length(strip(F.coalesce(F.col(ctx), F.lit("")))) > 0)
    )


def rejection_reasons(best="best_score", ctx="ctx", threshold: float = THRESHOLD) -> Column:
    """Comma-joined reasons (``no_scores``, ``low_score_0.2190<0.38``, ``empty_context``); '' if accepted."""
    b = F.col(best)
    low = b.isNotNull() & (b < F.lit(threshold))
    reasons = F.array(
        F.when(b.isNull(), F.lit("no_scores")),
        F.when(low, F.format_string(f"low_score_%.4f<{threshold}", b)),
        F.when(F.length(strip(F.coalesce(F.col(ctx), F.lit("")))) == 0, F.lit("empty_context")),
    )
    return F.array_join(F.array_compact(reasons), ", ")


def refuse_broken(col) -> Column:
    """A broken answer becomes REFUSE."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(is_broken(c), F.lit(REFUSE)).otherwise(c)


def is_refused_or_bad(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | (F.length(strip(c)) == 0) | is_broken(c) | (F.lower(strip(c)) == REFUSE.lower())


def fallback_answer(primary="primary", alt="alt") -> Column:
    """G8 (engine form): bad primary -> alternative unless it is blank/REFUSE, then primary (or REFUSE)."""
    p, a = F.col(primary), F.col(alt)
    alt_ok = a.isNotNull() & (F.length(a) > 0) & (F.lower(strip(a)) != REFUSE.lower())
    keep_primary = F.when((F.length(F.coalesce(p, F.lit(""))) > 0), p).otherwise(F.lit(REFUSE))
    return F.when(is_refused_or_bad(p), F.when(alt_ok, a).otherwise(keep_primary)).otherwise(p)


def fallback_answer_chat(primary="primary", alt="alt") -> Column:
    """G8 (chat form): the alternative must also not be broken; empty result -> REFUSE."""
    p, a = F.col(primary), F.col(alt)
    alt_ok = a.isNotNull() & (F.length(strip(a)) > 0) & (F.lower(strip(a)) != REFUSE.lower()) & ~is_broken(a)
    chosen = F.when(is_refused_or_bad(p) & alt_ok, a).otherwise(p)
    return F.when(F.length(F.coalesce(chosen, F.lit(""))) > 0, chosen).otherwise(F.lit(REFUSE))


def merge_answers(questions: DataFrame, branches: list[DataFrame], key: str = "qid") -> DataFrame:
    """Union the branch answers and left-join them onto the questions; missing -> REFUSE."""
    merged = branches[0]
    for b in branches[1:]:
        merged = merged.unionByName(b, allowMissingColumns=True)
    out = questions.join(merged, key, "left")
    return out.withColumn("answer", F.coalesce(F.col("answer"), F.lit(REFUSE)))
