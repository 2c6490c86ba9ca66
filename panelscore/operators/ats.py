"""ATS scorer output: strict whole-text parse, summary rows and feedback (JSN-5, STR-12/13, JN-6, AGG-19)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (
    ATS_BAND_GREEN,
    ATS_BAND_RED,
    ATS_BAND_YELLOW,
    ATS_FALLBACK_SCORE,
    ATS_FALLBACK_SUGGESTION,
    ATS_FEEDBACK_TEMPLATE,
    ATS_NONE_GAPS,
    ATS_NONE_STRENGTHS,
    ATS_NONE_SUGGESTIONS,
    ATS_TABLE_HEADER,
)
from ..functions.judgment import field, parse_single
from ..functions.text import fill, strip

_LIST_OK = r"^ARRAY<(STRING|VOID)>$"


def _list(v):
    """(valid, array<string>) of a list field; a missing key is an empty list, a string the list of its characters."""
    kind = F.schema_of_variant(v)
    valid = v.isNull() | kind.rlike(_LIST_OK) | (kind == "STRING")
    chars = F.filter(F.split(F.try_variant_get(v, "$", "string"), ""), lambda c: c != "")
    arr = F.when(kind == "STRING", chars).otherwise(F.try_variant_get(v, "$", "array<string>"))
    return valid, F.coalesce(arr, F.array().cast("array<string>"))


def _score_text(v):
    """The score as it is shown: integers as they are, other numbers with their fraction (85.0), True/False, None."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double").cast("string"))
        .otherwise(F.coalesce(text, F.lit("None")))
    )


def parse_ats(raw: DataFrame, keys: Sequence[str] = ("prompt_id", "model")) -> DataFrame:
    """JSN-5: the whole stripped text must be one JSON value.

    status: ``fallback`` when it does not parse (score 50, no strengths, one
    suggestion), ``na`` when it parses but has no ``ats_score`` or a strengths /
    suggestions value that is not a list of strings, else ``ok``.
    """
    keys = list(keys)
    p = raw.select(*keys, parse_single(strip(F.col("raw_text"))).alias("_v"))
    p = p.select(
        *keys, "_v",
        field(F.col("_v"), "ats_score").alias("_score"),
        field(F.col("_v"), "strengths").alias("_str"),
        field(F.col("_v"), "gaps").alias("_gaps"),
        field(F.col("_v"), "suggestions").alias("_sug"),
    )
    str_ok, str_arr = _list(F.col("_str"))
    gap_ok, gap_arr = _list(F.col("_gaps"))
    sug_ok, sug_arr = _list(F.col("_sug"))
    is_obj = F.schema_of_variant("_v").startswith("OBJECT<")
    status = (
        F.when(F.col("_v").isNull(), F.lit("fallback"))
        .when(~is_obj | F.col("_score").isNull() | ~str_ok | ~sug_ok, F.lit("na"))
        .otherwise(F.lit("ok"))
    )
    fb = F.col("status") == "fallback"
    ok = F.col("status") == "ok"
    staged = p.select(
        *keys, status.alias("status"),
        F.try_variant_get("_score", "$", "double").alias("_score_d"),
        _score_text(F.col("_score")).alias("_score_s"),
        str_arr.alias("_s"), F.when(gap_ok, gap_arr).alias("_g"), sug_arr.alias("_u"),
    )
    empty = F.array().cast("array<string>")
    return staged.select(
        *keys,
        "status",
        F.when(fb, F.lit(float(ATS_FALLBACK_SCORE))).when(ok, F.col("_score_d")).alias("ats_score"),
        F.when(fb, F.lit(str(ATS_FALLBACK_SCORE))).when(ok, F.col("_score_s")).alias("score_text"),
        F.when(fb, empty).when(ok, F.col("_s")).alias("strengths"),
        F.when(fb, empty).when(ok, F.col("_g")).alias("gaps"),
        F.when(fb, F.array(F.lit(ATS_FALLBACK_SUGGESTION))).when(ok, F.col("_u")).alias("suggestions"),
    )


def summary_rows(parsed: DataFrame) -> DataFrame:
    """STR-12: one markdown table row per (prompt, model); N/A row when unusable."""
    na = F.col("status") == "na"
    row = F.when(na, F.concat(F.lit("| "), F.col("model"), F.lit(" | N/A | N/A | N/A |"))).otherwise(
        F.concat(
            F.lit("| "), F.col("model"), F.lit(" | "), F.col("score_text"), F.lit(" | "),
            F.array_join("strengths", ", "), F.lit(" | "), F.array_join("suggestions", ", "), F.lit(" |"),
        )
    )
    return parsed.select("*", row.alias("row_md"))


def _bullets(arr, prefix, none_text):
    return F.when(F.size(arr) == 0, F.lit(none_text)).otherwise(
        F.array_join(F.transform(arr, lambda x: F.concat(F.lit(prefix), x)), "\n")
    )


def feedback(parsed: DataFrame) -> DataFrame:
    """STR-13: colour band and feedback card for every scored row (ok or fallback); a null score has no band and no card."""
    scored = parsed.where((F.col("status") != "na") & F.col("ats_score").isNotNull())
    band = (
        F.when(F.col("ats_score") >= 75, F.lit("green"))
        .when(F.col("ats_score") >= 50, F.lit("yellow"))
        .otherwise(F.lit("red"))
    )
    color = (
        F.when(F.col("ats_score") >= 75, F.lit(ATS_BAND_GREEN))
        .when(F.col("ats_score") >= 50, F.lit(ATS_BAND_YELLOW))
        .otherwise(F.lit(ATS_BAND_RED))
    )
    card = fill(
        ATS_FEEDBACK_TEMPLATE,
        score=F.col("score_text"),
        color=color,
        strengths=_bullets(F.col("strengths"), "* ", ATS_NONE_STRENGTHS),
        gaps=_bullets(F.coalesce("gaps", F.array().cast("array<string>")), "* ", ATS_NONE_GAPS),
        suggestions=_bullets(F.col("suggestions"), "1. ", ATS_NONE_SUGGESTIONS),
    )
    return scored.select("prompt_id", "model", band.alias("band"), card.alias("feedback_md"))


def batch_summary(prompts: DataFrame, rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """JN-6 + AGG-19: per prompt the ATS table (header + rows in panel order), joined back.

    Each prompt group holds one row per panel model, so the ordered string
    aggregation is bounded by the panel size.
    """
    order = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    table = rows.groupBy("prompt_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("row_md").alias("r")))), lambda x: x["r"]),
            "\n",
        ).alias("_rows")
    )
    table = table.select("prompt_id", F.concat(F.lit(ATS_TABLE_HEADER), F.col("_rows")).alias("ats_summary"))
    return prompts.join(table, "prompt_id", "left")
