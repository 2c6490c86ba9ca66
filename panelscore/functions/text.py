"""String helpers as Column expressions (STR-*), all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    ATS_SCORE_TEMPLATE,
    ATS_TASK_TEMPLATE,
    RUN_TS_FORMAT,
    JUDGE_TEMPLATE,
    REASONING_TEMPLATE,
    SEARCH_MARKER,
)

# Whitespace removed by a Python-style strip() (Spark's trim only removes spaces).
_WS = (
    r"[\s\x0B\f\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def strip(c: Column) -> Column:
    """STR-9: remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", "")


def blank(c: Column) -> Column:
    """Null or empty string counts as absent."""
    return F.coalesce(c, F.lit("")) == ""


def preview(c: Column, n: int = 100) -> Column:
    """STR-10: first ``n`` characters followed by '...' (always appended)."""
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def response_card(response: Column, reasoning: Column) -> Column:
    """STR-11: response plus explainability markdown."""
    return F.concat(
        F.lit("### Response\n\n"), response, F.lit("\n\n---\n\n**Explainability:**\n"), reasoning
    )


def is_error(c: Column) -> Column:
    """FLT-5: text is an error sentinel '[... Error] ...'."""
    return F.coalesce(c.rlike(r"^\[[^\]]* Error\] "), F.lit(False))


def error_text(role: Column, model: Column, message: Column) -> Column:
    """STR-16: what a failed call of a role leaves as its text (null for roles without one)."""
    return F.when(role == "answer", F.concat(F.lit("["), model, F.lit(" Error] "), message)).when(
        role == "reasoning", F.concat(F.lit("[Reasoning Error] "), message)
    )


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.regexp_extract_all(c, F.lit(r"\S+"), 0))


def fill(template: str, **cols: Column) -> Column:
    """Fill a ``str.format`` template with columns (literal parts stay literal)."""
    import string

    parts = []
    for literal, name, _spec, _conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(cols[name].cast("string"), F.lit("None")))
    return F.concat(*parts)


def is_ats(resume: Column, jd: Column) -> Column:
    """STR-5: an ATS request needs both a résumé and a job description."""
    return ~blank(resume) & ~blank(jd)


def realtime_flag(raw: Column) -> Column:
    """STR-6: classifier answer counts as real-time when it contains 'true' (any case)."""
    return F.coalesce(F.lower(strip(raw)).contains("true"), F.lit(False))


def build_prompt(prompt: Column, resume: Column, jd: Column, snippets: Column) -> Column:
    """STR-1: ATS task if résumé and jd given, else prompt + search block, else prompt."""
    return (
        F.when(is_ats(resume, jd), fill(ATS_TASK_TEMPLATE, resume=resume, jd=jd))
        .when(~blank(snippets), F.concat(prompt, F.lit(SEARCH_MARKER), snippets))
        .otherwise(prompt)
    )


def judge_prompt(prompt: Column, target: Column, response: Column) -> Column:
    """STR-2: the evaluation request sent to a judge."""
    return fill(JUDGE_TEMPLATE, prompt=prompt, target=target, response=response)


def reasoning_prompt(response: Column, prompt: Column) -> Column:
    """STR-4: follow-up asking a model to explain its answer."""
    return fill(REASONING_TEMPLATE, response=response, prompt=prompt)


def ats_score_prompt(response: Column, resume: Column, jd: Column) -> Column:
    """STR-3: the ATS scoring request for one response."""
    return fill(ATS_SCORE_TEMPLATE, resume=resume, jd=jd, response=response)


def run_id(ts: Column, suffix: Column | None = None) -> Column:
    """DTE-1: run identifier ``yyyyMMdd_HHmmss`` (optional ``_prompt_<i>`` suffix).

    The timestamp is passed in (never ``now()`` inside a plan), so re-running a
    plan reproduces the same identifier.
    """
    base = F.date_format(ts, RUN_TS_FORMAT)
    return base if suffix is None else F.concat(base, F.lit("_prompt_"), suffix.cast("string"))
