"""Response-level operators: side-by-side view, status counts, lengths (RSH-4, FLT-4/5, AGG-17, STR-17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, is_error, preview, response_card, word_count


def side_by_side(responses: DataFrame, models: Sequence[str]) -> DataFrame:
    """RSH-4: one row per prompt, one response card column per model (absent -> null).

    Pivot values are the panel (no distinct job); each cell holds at most one
    response because (prompt_id, model) is unique.
    """
    cards = responses.select(
        "prompt_id", "model", response_card(F.col("response"), F.col("reasoning")).alias("card")
    )
    return cards.groupBy("prompt_id").pivot("model", list(models)).agg(F.first("card"))


def response_previews(responses: DataFrame) -> DataFrame:
    """STR-10: 100-character previews of usable responses."""
    return responses.where(~blank(F.col("response"))).select("prompt_id", "model", preview(F.col("response")).alias("preview"))


def response_status(responses: DataFrame, errors: str = "keep") -> DataFrame:
    """FLT-4/FLT-5/AGG-17: per model counts of blank, error and kept responses.

    ``errors='keep'`` judges error sentinels like answers (protocol behaviour);
    ``'drop'`` removes them as well.
    """
    if errors not in ("keep", "drop"):
        raise ValueError("errors must be 'keep' or 'drop'")
    b = blank(F.col("response"))
    e = is_error(F.col("response"))
    kept = ~b if errors == "keep" else (~b & ~e)
    return responses.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_responses"),
        F.count(F.when(b, 1)).alias("n_blank"),
        F.count(F.when(e, 1)).alias("n_error"),
        F.count(F.when(kept, 1)).alias("n_kept"),
        F.count_distinct(F.when(kept, F.col("prompt_id"))).alias("n_prompts"),
    )


def response_lengths(responses: DataFrame) -> DataFrame:
    """STR-17: per model length statistics of usable responses (characters and words)."""
    r = responses.where(~blank(F.col("response"))).select(
        "model", F.length("response").cast("long").alias("chars"), word_count(F.col("response")).alias("words")
    )
    return r.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.bround(F.avg("chars"), 3).alias("avg_chars"),
        F.min("chars").alias("min_chars"),
        F.max("chars").alias("max_chars"),
        F.bround(F.percentile(F.col("chars").cast("double"), 0.5), 3).alias("median_chars"),
        F.bround(F.avg("words"), 3).alias("avg_words"),
    )


def display_view(responses: DataFrame, models: Sequence[str], batch_key: str = "run_id") -> DataFrame:
    """SRT-3: what a batch shows at the end.

    Per prompt the search text and ATS flag come from the first panel model
    (``min_by`` over ``model_idx``); per batch every model tab shows the response
    of the last prompt (``max_by`` over ``prompt_id``); the search tab shows
    the last prompt's search text or 'N/A'. Both are algebraic aggregates, so a
    huge batch is never gathered in one place.
    """
    per_prompt = responses.groupBy(batch_key, "prompt_id").agg(
        F.min_by("search_results", "model_idx").alias("search_results"),
        F.min_by("is_ats", "model_idx").alias("is_ats"),
        *[F.max(F.when(F.col("model") == m, F.coalesce("card", "response"))).alias(m) for m in models],
    )
    return per_prompt.groupBy(batch_key).agg(
        *[F.max_by(F.col(f"`{m}`"), "prompt_id").alias(m) for m in models],
        F.coalesce(F.max_by(F.nullif("search_results", F.lit("")), "prompt_id"), F.lit("N/A")).alias("search_tab"),
        F.max_by("is_ats", "prompt_id").alias("is_ats"),
    )
