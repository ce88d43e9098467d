"""Independent DuckDB SQL statements of the registered queries.

The correctness gate runs every Spark query next to its SQL statement here on
the same parquet tables.  The SQL is written from the behaviour spec, not by
translating the Spark code: it uses DuckDB's own idioms (``generate_series`` +
``substring`` for chunk windows, ``string_agg ... ORDER BY`` for contexts,
``unnest`` + window ranking for sentence choice).  Regex classes are shared
text because both engines must agree on Python's Unicode character classes.
"""
from __future__ import annotations

from .functions import text as T
from .functions.arithmetic import DEFAULT_PI, ORDINAL_POWERS
from .operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, MIN_CHUNK_CHARS
from .operators.context import MAX_CTX_CHARS, piece_length
from .operators.routing import THRESHOLD
from .operators.vectors import SCORE_DIGITS, TOP_K


def lit(s: str) -> str:
    """SQL string literal; control characters spelled with chr()."""
    parts, buf = [], []
    for ch in s:
        if ord(ch) < 32 or ord(ch) in (0x85,):
            if buf:
                parts.append("'" + "".join(buf).replace("'", "''") + "'")
                buf = []
            parts.append(f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf or not parts:
        parts.append("'" + "".join(buf).replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


WS_SET = lit(T.WS_CHARS)
REFUSE = lit(T.REFUSE)


def rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS_SET})"


def norm(x: str) -> str:
    """B1 in SQL."""
    return (f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), {rx(T.PUNCT_RUN)}, ' ', 'g'), "
            f"{rx(T.WS + '+')}, ' ', 'g'))")


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda tk: tk <> '')"


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, '\\P{{L}}', '', 'g'))"


def ends_ne(low: str) -> str:
    return f"regexp_matches({low}, {rx('(?:\\A|' + T.WS + ')не\\.?\\z')})"


def in_list(x: str, values) -> str:
    return f"{x} IN ({', '.join(lit(v) for v in values)})"


def refusal(low: str, phrases=T.REFUSAL_PHRASES) -> str:
    return "(" + " OR ".join(f"contains({low}, {lit(p)})" for p in phrases) + ")"


def translation(t: str) -> str:
    quotes = lit("\"'«»")
    cleaned = strip(f"translate({t}, {quotes}, '')")
    m = f"regexp_extract({cleaned}, {rx(r'[A-Za-z][A-Za-z .,!?' + chr(39) + r'\-]*')}, 0)"
    eng = f"trim({strip(m)}, ' .')"
    return f"CASE WHEN length({eng}) > 0 THEN {eng} ELSE {REFUSE} END"


def cap_words(t: str, n: int) -> str:
    words = f"string_split_regex({strip(t)}, {rx(T.WS + '+')})"
    capped = f"rtrim(array_to_string(({words})[1:{n}], ' '), ',;:')"
    return (f"CASE WHEN len({words}) > {n} THEN (CASE WHEN suffix({capped}, '.') THEN {capped} ELSE {capped} || '.' END) "
            f"ELSE {t} END")


def first_sentence(t: str, min_end: int = 0) -> str:
    head = f"regexp_extract({t}, {rx(r'\A[^.!?]*[.!?]')}, 0)"
    cond = f"length({head}) > 0 AND length({head}) < length({t})"
    if min_end:
        cond += f" AND length({head}) >= {min_end}"
    return f"CASE WHEN {cond} THEN {strip(head)} ELSE {t} END"


def clean_answer(src: str, raw: str, q: str | None, out: str, keep: str = "*") -> str:
    """B17 as a chain of SELECTs over relation ``src``; adds column ``out``."""
    qexpr = q if q else "CAST(NULL AS VARCHAR)"
    qs = strip(f"coalesce({qexpr}, '')")
    echo_set = lit(T.ECHO_CHARS_POST)
    t0 = strip(f"coalesce({raw}, '')")
    s1 = (f"SELECT {keep}, {t0} AS __t0, {qs} AS __qs, "
          f"lower(coalesce({qexpr}, '')) AS __ql FROM {src}")
    s2 = (f"SELECT *, CASE WHEN length(__qs) > 0 AND starts_with(lower(__t0), lower(__qs)) "
          f"THEN ltrim(substring(__t0, length(__qs) + 1), {echo_set}) ELSE __t0 END AS __t1 FROM ({s1})")
    s3 = f"SELECT *, {first_sentence('__t1')} AS __t2 FROM ({s2})"
    s4 = f"SELECT *, lower(__t2) AS __low FROM ({s3})"
    frag = (f"(suffix(__t2, '?') AND NOT {in_list('__low', T.QUESTION_OK)}) OR {ends_ne('__low')} "
            f"OR ({letters('__t2')} <= 2 AND NOT {in_list('__low', T.SHORT_OK)})")
    res = (f"CASE WHEN length(__t0) = 0 THEN {REFUSE} WHEN {refusal('__low')} THEN {REFUSE} "
           f"WHEN {frag} THEN {REFUSE} WHEN contains(__ql, {lit(T.TRANSLATE_TRIGGER)}) THEN {translation('__t2')} "
           f"ELSE {cap_words('__t2', T.CAP_WORDS)} END")
    s5 = f"SELECT *, {res} AS __res FROM ({s4})"
    return (f"SELECT * EXCLUDE (__t0, __qs, __ql, __t1, __t2, __low, __res), "
            f"CASE WHEN length(__res) = 0 THEN {REFUSE} ELSE __res END AS {out} FROM ({s5})")


def is_broken(x: str) -> str:
    """B14 as a boolean SQL expression (x evaluated several times; use on a column)."""
    t = strip(f"coalesce({x}, '')")
    low = f"lower({t})"
    words = f"len(regexp_extract_all(lower({t}), {rx(T.WORD_RUN)}))"
    numeric = f"regexp_matches({t}, {rx(r'\A\p{Nd}+[.,]?\p{Nd}*\z')})"
    return (f"(length({t}) = 0 OR suffix({t}, '?') OR {ends_ne(low)} OR length({t}) <= 2 OR {letters(t)} <= 2 "
            f"OR ({words} <= 1 AND NOT {numeric}) OR {in_list(low, T.BROKEN_SET)})")


def documents_cte() -> str:
    title, text = strip("coalesce(source, '')"), strip("coalesce(text, '')")
    return f"docs AS (SELECT doc_id, {title} AS title, {text} AS text FROM documents WHERE length({text}) > 0)"


def chunks_cte(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, src: str = "docs") -> str:
    step = size - overlap
    return (
        f"win AS (SELECT doc_id, title, text, unnest(generate_series(0, CAST(greatest(0, ceil((length(text) - {size}) / {step}.0)) AS BIGINT))) AS pos FROM {src}), "
        f"chunks AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, title, {strip(f'substring(text, pos * {step} + 1, {size})')} AS text FROM win "
        f"WHERE length({strip(f'substring(text, pos * {step} + 1, {size})')}) >= {MIN_CHUNK_CHARS})"
    )


def vectors_cte(name: str, src: str, ids: str, text: str, term: str = "form") -> str:
    """Unit term-frequency vectors ``(ids, term, w)`` of ``src.text``; ``term``: what is counted of a token ``form``."""
    return (
        f"{name}_tok AS (SELECT {ids}, {term} AS term FROM (SELECT {ids}, unnest({tokens(norm(text))}) AS form FROM {src})), "
        f"{name}_tf AS (SELECT {ids}, term, count(*) AS tf FROM {name}_tok GROUP BY {ids}, term), "
        f"{name} AS (SELECT {ids}, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY {ids})) AS w FROM {name}_tf)"
    )


def benchmark_questions_cte() -> str:
    text = strip("coalesce(text, '')")
    return f"qs AS (SELECT CAST(item_id AS BIGINT) AS qid, {text} AS question FROM benchmark WHERE length({text}) > 0)"


def retrieval_ctes(questions: str = "qs", k: int = TOP_K, max_ctx: int = MAX_CTX_CHARS, term: str = "form", every: bool = False) -> str:
    """top-k, fetch, context: defines ``top`` and ``retr(qid, best_score, ctx)``.

    ``term``: what is counted of a token; ``every``: pairs without a common term score 0 (dense vectors)."""
    per = piece_length(k, max_ctx)
    return ", ".join([
        vectors_cte("cvec", "chunks", "doc_id, pos", "text", term),
        vectors_cte("qvec", questions, "qid", "question", term),
        f"{'met' if every else 'scores'} AS (SELECT q.qid, c.doc_id, c.pos, sum(q.w * c.w) AS score FROM qvec q JOIN cvec c ON q.term = c.term "
        "GROUP BY q.qid, c.doc_id, c.pos)",
        *([f"scores AS (SELECT q.qid, c.doc_id, c.pos, coalesce(m.score, 0.0) AS score FROM {questions} q CROSS JOIN chunks c "
           "LEFT JOIN met m ON m.qid = q.qid AND m.doc_id = c.doc_id AND m.pos = c.pos)"] if every else []),
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, {SCORE_DIGITS}) DESC, doc_id, pos) AS rank FROM scores)",
        f"top AS (SELECT * FROM ranked WHERE rank <= {k})",
        "fetched AS (SELECT t.qid, t.rank, t.score, t.doc_id, t.pos, coalesce(c.title, '') AS title, coalesce(c.text, '') AS text "
        "FROM top t LEFT JOIN chunks c ON t.doc_id = c.doc_id AND t.pos = c.pos)",
        f"pieces AS (SELECT *, CASE WHEN length(text) > 0 THEN (CASE WHEN title <> '' THEN title || ': ' ELSE '' END) "
        f"|| substring({strip('text')}, 1, {per}) END AS piece FROM fetched)",
        f"retr AS (SELECT qid, max(score) AS best_score, substring(coalesce(string_agg(piece, chr(10) || chr(10) ORDER BY rank), ''), 1, {max_ctx}) AS ctx "
        "FROM pieces GROUP BY qid)",
    ])


def gate(best: str = "best_score", ctx: str = "ctx", threshold: float = THRESHOLD) -> str:
    c = strip(f"coalesce({ctx}, '')")
    return f"({best} IS NOT NULL AND {best} >= {threshold} AND length({c}) > 0)"


def extractive_ctes(src: str) -> str:
    """I3 over ``src(qid, question, ctx)``: defines ``picked(qid, raw)``."""
    sent = r"([^.!?\n]+[.!?]?)"
    return ", ".join([
        f"sl AS (SELECT qid, question, regexp_extract_all(coalesce(ctx, ''), {rx(sent)}, 1) AS lst FROM {src})",
        "si AS (SELECT qid, question, lst, unnest(range(1, len(lst) + 1)) AS idx FROM sl)",
        f"ss AS (SELECT qid, question, idx, {strip('lst[idx]')} AS s FROM si)",
        f"sc AS (SELECT qid, idx, s, len(list_intersect(list_distinct({tokens(norm('s'))}), list_distinct({tokens(norm('question'))}))) AS score "
        "FROM ss WHERE length(s) > 0)",
        "sb AS (SELECT qid, s, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS r FROM sc)",
        f"picked AS (SELECT a.qid, coalesce(b.s, '') AS raw FROM {src} a LEFT JOIN sb b ON a.qid = b.qid AND b.r = 1)",
    ])


def fmt_number(v: str) -> str:
    """C11: DuckDB printf('%.10g') formats like Python."""
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN abs({v} - round({v})) < 1e-9 THEN CAST(CAST(round({v}) AS HUGEINT) AS VARCHAR) || '.' "
            f"ELSE replace(printf('%.10g', {v}), '.', ',') || '.' END")


def flagship(k: int = TOP_K, threshold: float = THRESHOLD, qs_cte: str | None = None, tail: str | None = None, term: str = "form",
             every: bool = False) -> str:
    """I5 answer_questions: questions ``qs(qid, question)`` (benchmark by default) over documents.

    ``tail`` replaces the final SELECT; it can read ``routed`` and ``allr``."""
    final = tail or (f"SELECT q.qid, q.question, coalesce(a.answer, {REFUSE}) AS answer, coalesce(a.route, 'refused') AS route, "
                     f"round(a.best_score, 6) AS best_score FROM routed q LEFT JOIN allr a ON q.qid = a.qid")
    return (
        f"WITH {documents_cte()}, {chunks_cte()}, {qs_cte or benchmark_questions_cte()}, "
        f"routed AS ({math_select('qs', 'question', 'math')}), "
        f"rest AS (SELECT qid, question FROM routed WHERE math IS NULL), "
        f"{retrieval_ctes('rest', k, term=term, every=every)}, "
        f"judged AS (SELECT r.qid, r.question, x.best_score, x.ctx, {gate('x.best_score', 'x.ctx', threshold)} AS ok "
        f"FROM rest r LEFT JOIN retr x ON r.qid = x.qid), "
        f"acc AS (SELECT qid, question, ctx, best_score FROM judged WHERE ok), "
        f"{extractive_ctes('acc')}, "
        f"gen AS (SELECT a.qid, a.question, a.best_score, p.raw FROM acc a JOIN picked p ON a.qid = p.qid), "
        f"cleaned AS ({clean_answer('gen', 'raw', 'question', 'cleaned')}), "
        f"ctx_rows AS (SELECT qid, CASE WHEN {is_broken('cleaned')} THEN {REFUSE} ELSE cleaned END AS answer, "
        f"'context' AS route, best_score FROM cleaned), "
        f"rej_rows AS (SELECT qid, {REFUSE} AS answer, 'refused' AS route, best_score FROM judged WHERE NOT ok), "
        f"math_rows AS (SELECT qid, math AS answer, 'math' AS route, CAST(NULL AS DOUBLE) AS best_score FROM routed WHERE math IS NOT NULL), "
        f"allr AS (SELECT * FROM math_rows UNION ALL SELECT * FROM rej_rows UNION ALL SELECT * FROM ctx_rows) "
        f"{final}"
    )


# ---------------------------------------------------------------------------
# Arithmetic rules in SQL (C1-C12).  Each rule yields a struct {refuse, value}
# or NULL, mirroring the first-match-wins order.
# ---------------------------------------------------------------------------

def _g(q: str, pattern: str, idx: int) -> str:
    return f"nullif(regexp_extract({q}, {rx(pattern)}, {idx}), '')"


def _n(x: str) -> str:
    return f"TRY_CAST(replace({x}, ',', '.') AS DOUBLE)"


def _fire(value: str, refuse: bool = False) -> str:
    return f"{{'refuse': {'true' if refuse else 'false'}, 'value': CAST({value} AS DOUBLE)}}"


def _math_groups(q: str) -> dict[str, str]:
    """Every capture the rules read, as named columns over the lowered question ``q``."""
    from .functions import arithmetic as A

    return {
        "__b_a": _n(_g(q, A.RE_BINARY, 1)), "__b_op": _g(q, A.RE_BINARY, 2), "__b_b": _n(_g(q, A.RE_BINARY, 3)),
        "__d_a": _n(_g(q, A.RE_DIVIDE, 1)), "__d_b": _n(_g(q, A.RE_DIVIDE, 3)),
        "__m_a": _n(_g(q, A.RE_MULTIPLY, 1)), "__m_b": _n(_g(q, A.RE_MULTIPLY, 3)),
        "__s_a": _n(_g(q, A.RE_SUM, 1)), "__s_b": _n(_g(q, A.RE_SUM, 2)),
        "__p_p": _n(_g(q, A.RE_PERCENT, 1)), "__p_b": _n(_g(q, A.RE_PERCENT, 2)),
        "__a_body": _g(q, A.RE_MEAN, 1),
        "__r_n": f"TRY_CAST({_g(q, A.RE_SQRT, 1)} AS BIGINT)",
        "__w_base": _n(_g(q, A.RE_POWER, 1)), "__w_word": _g(q, A.RE_POWER, 2),
        "__c_r": _n(_g(q, A.RE_CIRCLE, 1)), "__c_pi": f"coalesce({_n(_g(q, A.RE_PI, 1))}, {DEFAULT_PI})",
    }


def _math_rules() -> dict[str, str]:
    """Rule results over the group columns: struct {refuse, value} or NULL."""
    from .functions import arithmetic as A

    binary = (f"CASE WHEN {in_list('__b_op', A.OPS_PLUS)} THEN {_fire('__b_a + __b_b')} "
              f"WHEN {in_list('__b_op', A.OPS_MINUS)} THEN {_fire('__b_a - __b_b')} "
              f"WHEN {in_list('__b_op', A.OPS_TIMES)} THEN {_fire('__b_a * __b_b')} "
              f"WHEN {in_list('__b_op', A.OPS_DIV)} AND __b_b = 0 THEN {_fire('NULL', True)} "
              f"WHEN {in_list('__b_op', A.OPS_DIV)} THEN {_fire('__b_a / __b_b')} END")
    divide = f"CASE WHEN __d_b = 0 THEN {_fire('NULL', True)} WHEN __d_b IS NOT NULL THEN {_fire('__d_a / __d_b')} END"
    multiply = f"CASE WHEN __m_b IS NOT NULL THEN {_fire('__m_a * __m_b')} END"
    summ = f"CASE WHEN __s_b IS NOT NULL THEN {_fire('__s_a + __s_b')} END"
    percent = f"CASE WHEN __p_b IS NOT NULL THEN {_fire('__p_b * __p_p / 100.0')} END"
    nums = "list_transform(regexp_extract_all(__a_body, '([0-9]+)', 1), lambda s: CAST(s AS DOUBLE))"
    mean = f"CASE WHEN __a_body IS NOT NULL AND len({nums}) > 0 THEN {_fire(f'list_sum({nums}) / len({nums})')} END"
    r = "CAST(round(sqrt(CAST(__r_n AS DOUBLE))) AS BIGINT)"
    sqrt = (f"CASE WHEN __r_n IS NULL THEN NULL WHEN CAST({r} AS HUGEINT) * {r} = __r_n THEN {_fire(r)} "
            f"ELSE {_fire('NULL', True)} END")
    exp = "CASE " + " ".join(f"WHEN __w_word = {lit(k)} THEN {v}" for k, v in ORDINAL_POWERS.items()) + " END"
    power = f"CASE WHEN ({exp}) IS NOT NULL THEN {_fire(f'pow(__w_base, {exp})')} END"
    circle = f"CASE WHEN __c_r IS NOT NULL THEN {_fire('__c_pi * (__c_r * __c_r)')} END"
    return {"math_binary": binary, "math_divide": divide, "math_multiply": multiply, "math_sum": summ,
            "math_percent": percent, "math_mean": mean, "math_sqrt": sqrt, "math_power": power, "math_circle": circle}


def render_rule(res: str) -> str:
    return f"CASE WHEN {res} IS NULL THEN NULL WHEN {res}.refuse THEN {REFUSE} ELSE {fmt_number(f'{res}.value')} END"


def math_select(src: str, question: str, out: str, rule: str | None = None) -> str:
    """C12 (or one rule C1-C10) over relation ``src``; adds column ``out``."""
    groups = _math_groups("__q")
    rules = _math_rules()
    chosen = rules[rule] if rule else "coalesce(" + ", ".join(rules.values()) + ")"
    tmp = ["__q", *groups, "__res"]
    s1 = f"SELECT *, lower({strip(question)}) AS __q FROM {src}"
    s2 = f"SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in groups.items()) + f" FROM ({s1})"
    s3 = f"SELECT *, {chosen} AS __res FROM ({s2})"
    return f"SELECT * EXCLUDE ({', '.join(tmp)}), {render_rule('__res')} AS {out} FROM ({s3})"


# ---------------------------------------------------------------------------
# Text operators (B) in SQL
# ---------------------------------------------------------------------------

def norm_basic(x: str) -> str:
    return (f"{strip(f'regexp_replace(regexp_replace(lower({strip(f"coalesce({x}, {chr(39) * 2})")}), {rx(T.BASIC_PUNCT_CLASS + "+")}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)}), {rx(T.WS + "+")}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}")


def strip_echo(t: str, q: str, chars: str = T.ECHO_CHARS_POST) -> str:
    qs = strip(f"coalesce({q}, '')")
    return (f"CASE WHEN length({qs}) > 0 AND starts_with(lower({t}), lower({qs})) "
            f"THEN ltrim(substring({t}, length({qs}) + 1), {lit(chars)}) ELSE {t} END")


def drop_role_lines(t: str) -> str:
    lines = f"list_transform(string_split_regex({t}, {rx(T.LINE_BREAK)}), lambda l: {strip('l')})"
    kept = f"list_filter({lines}, lambda l: length(l) > 0 AND NOT starts_with(lower(l), 'assistant'))"
    return f"coalesce(({kept})[1], '')"


def strip_role_suffix(t: str) -> str:
    return f"regexp_replace({t}, {rx('(?i)(?:' + T.WS + '*assistant:?)+' + T.WS + '*\\z')}, '')"


def strip_role_prefix(t: str) -> str:
    return f"CASE WHEN starts_with(lower({t}), 'assistant') THEN trim(substring({t}, 10), {lit(': ' + chr(10))}) ELSE {t} END"


def is_fragment(t: str) -> str:
    low = f"lower({t})"
    return (f"((suffix({t}, '?') AND NOT {in_list(low, T.QUESTION_OK)}) OR {ends_ne(low)} "
            f"OR ({letters(t)} <= 2 AND NOT {in_list(low, T.SHORT_OK)}))")


def ellipsize(t: str, n: int = 120) -> str:
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE substring({t}, 1, {n - 3}) || '...' END"


def clean_answer_basic(src: str, raw: str, q: str | None, out: str) -> str:
    qexpr = q if q else "CAST(NULL AS VARCHAR)"
    t0 = strip(f"coalesce({raw}, '')")
    s1 = f"SELECT *, {t0} AS __t0, lower(coalesce({qexpr}, '')) AS __ql FROM {src}"
    s2 = f"SELECT *, {first_sentence('__t0', 5)} AS __t1 FROM ({s1})"
    res = (f"CASE WHEN length(__t0) = 0 THEN {REFUSE} WHEN {refusal('lower(__t1)', T.REFUSAL_PHRASES_BASIC)} THEN {REFUSE} "
           f"WHEN contains(__ql, {lit(T.TRANSLATE_TRIGGER)}) THEN {translation('__t1')} "
           f"ELSE {cap_words('__t1', T.CAP_WORDS_BASIC)} END")
    s3 = f"SELECT *, {res} AS __res FROM ({s2})"
    return (f"SELECT * EXCLUDE (__t0, __ql, __t1, __res), CASE WHEN length(__res) = 0 THEN {REFUSE} ELSE __res END AS {out} "
            f"FROM ({s3})")


def clean_raw_output(src: str, raw: str, q: str, out: str) -> str:
    t0 = strip(f"coalesce({raw}, '')")
    s1 = f"SELECT *, {drop_role_lines(strip_echo(t0, q, T.ECHO_CHARS_RAW))} AS __r1 FROM {src}"
    return f"SELECT * EXCLUDE (__r1), {strip_role_suffix('__r1')} AS {out} FROM ({s1})"
