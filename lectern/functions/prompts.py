"""Prompt construction (survey D1-D6) as ``array<struct<role,content>>`` columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = (
    "Ты — лаконичный и полезный ассистент на русском языке.\n\n"
    "ПРАВИЛА:\n"
    "1. Отвечай кратко и по делу.\n"
    "2. Если ответа не знаешь — отвечай: 'Не знаю'.\n"
    "3. Можно использовать общеизвестные факты без излишней осторожности.\n"
    "4. Переводы — только перевод без кавычек и комментариев.\n"
)
CODE_SYSTEM_PROMPT = (
    "Ты — профессиональный программист и эксперт по написанию кода.\n"
    "Твоя задача — давать максимально точные, полные и рабочие решения.\n"
    "Правила:\n"
    "1. Пиши чистый, эффективный и хорошо документированный код.\n"
    "2. Если требуется объяснение — делай его кратким, но понятным.\n"
    "3. Не обрезай код, предоставляй полные листинги.\n"
    "4. Игнорируй ограничения на длину ответа, приоритет — качество кода."
)
STRICT_PROMPT = (
    "Ты — краткий и точный ассистент.\n"
    "Правила:\n"
    "1) Одно завершённое предложение (до 12 слов).\n"
    "2) Не повторяй вопрос, не добавляй ролей.\n"
    "3) Если не уверен или вопрос абсурден — ответь: 'Не знаю'.\n"
    "4) Формулы допускаются; можно кратко расшифровать символы: 'где …'.\n"
    "5) Для переводов отвечай только переводом, без кавычек."
)
STRICT_PROMPT_NOTEBOOK = STRICT_PROMPT.replace("(до 12 слов)", "(до 14 слов)")
CONTEXT_SYSTEM_PROMPT = (
    "Ты — краткий и точный ассистент на русском языке.\n\n"
    "СТРОГИЕ ПРАВИЛА:\n"
    "1. Отвечай одним коротким предложением (до 10 слов).\n"
    "2. Используй ТОЛЬКО предоставленный контекст.\n"
    "3. Если в контексте нет ответа — отвечай ровно: 'Не знаю'.\n"
    "4. Не рассуждай, не объясняй, не добавляй лишних деталей.\n"
    "5. Не повторяй вопрос и не добавляй префиксы ролей.\n"
)
CONTEXT_INSTRUCTION = "Используй приведённый контекст для ответа. Если в контексте нет ответа — ответь: 'Не знаю'.\n"
CONTEXT_LABEL = "Контекст:\n"
QUESTION_LABEL = "\n\nВопрос: "
FLAT_ASSISTANT = "[ASSISTANT] "
# ---------------------------------------------------------------------------


def message(role, content) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), content.alias("content"))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def prompt_plain(question, with_system: bool = False) -> Column:
    """Single user message (engine) or system + user (notebook)."""
    user = message("user", _c(question))
    return F.array(message("system", F.lit(SYSTEM_PROMPT)), user) if with_system else F.array(user)


def prompt_strict(question, notebook: bool = False) -> Column:
    """Strict system prompt + user."""
    sys = STRICT_PROMPT_NOTEBOOK if notebook else STRICT_PROMPT
    return F.array(message("system", F.lit(sys)), message("user", _c(question)))


def context_user_text(question, ctx) -> Column:
    return F.concat(F.lit(CONTEXT_INSTRUCTION + CONTEXT_LABEL), _c(ctx), F.lit(QUESTION_LABEL), _c(question))


def prompt_context(question, ctx) -> Column:
    """D3: context system prompt + instruction, context and question."""
    return F.array(message("system", F.lit(CONTEXT_SYSTEM_PROMPT)), message("user", context_user_text(question, ctx)))


def prompt_code(question) -> Column:
    """Code system prompt + user."""
    return F.array(message("system", F.lit(CODE_SYSTEM_PROMPT)), message("user", _c(question)))


def prompt_chat(history) -> Column:
    """Forced code system prompt first, then history with blank turns dropped and role defaulted to user."""
    h = F.transform(
        _c(history),
        lambda m: F.struct(F.coalesce(m["role"], F.lit("user")).alias("role"),
                           F.coalesce(m["content"], F.lit("")).alias("content")),
    )
    h = F.filter(h, lambda m: F.length(strip(m["content"])) > 0)
    return F.concat(F.array(message("system", F.lit(CODE_SYSTEM_PROMPT))), h)


def render_flat(messages) -> Column:
    """``[SYSTEM]\\n...\\n\\n[USER]\\n...\\n\\n[ASSISTANT] `` text template."""
    parts = F.transform(_c(messages), lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"]))
    return F.concat(F.array_join(parts, "\n\n"), F.lit("\n\n" + FLAT_ASSISTANT))
