"""Strict parsing of noisy judge output into typed scores (all JVM-side, no UDF).

Rules:
* the JSON block runs from the first ``{`` to the last ``}``, across newlines;
* the block must be exactly one JSON value: it is wrapped as ``[block]`` so that
  trailing text or a second object makes the parse fail (a bare parse would
  silently stop after the first value);
* an empty object counts as a failed judgment;
* a metric is *numeric* when it is a JSON number or boolean (booleans count, as
  integers do in the protocol), never a string or null;
* the row value of a metric: missing key -> 0.5, JSON null -> null, number or
  boolean -> double, numeric text -> its number, anything else -> null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_SCORE, METRICS

NUMERIC_TYPES = r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"


def json_block(text: Column) -> Column:
    """First ``{`` to last ``}`` (what a greedy, dot-all ``{.*}`` search finds); '' when absent.

    A match exists exactly when the last ``}`` comes after the first ``{``, so
    the block is cut with ``instr``/``reverse``/``substring`` in linear time
    (the regular expression backtracks quadratically on text with many ``{``
    and no ``}`` after them).
    """
    start = F.instr(text, "{")
    from_end = F.instr(F.reverse(text), "}")
    end = F.length(text) - from_end + 1
    ok = (start > 0) & (from_end > 0) & (end > start)
    return F.when(ok, text.substr(start, end - start + 1)).otherwise(F.lit(""))


def parse_single(text: Column) -> Column:
    """VARIANT of ``text`` when it is exactly one JSON value, else null."""
    arr = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    first = F.try_variant_get(arr, "$[0]", "variant")
    second = F.try_variant_get(arr, "$[1]", "variant")
    return F.when(second.isNull(), first)


def parse_status(block: Column, obj: Column) -> Column:
    return (
        F.when(block == "", F.lit("no_json"))
        .when(obj.isNull(), F.lit("bad_json"))
        .when(F.schema_of_variant(obj) == "OBJECT<>", F.lit("empty"))
        .otherwise(F.lit("ok"))
    )


def is_usable(raw: Column) -> Column:
    """True when ``raw`` holds exactly one non-empty JSON object block.

    One reference to the block and one parse: the wrapper array is folded with
    ``aggregate`` (an element that is a non-empty object adds 1, anything else
    adds 2, so the sum is 1 exactly for a single usable object). Filters built
    on it stay cheap when the optimizer pushes them below other projections.
    """
    arr = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), json_block(raw), F.lit("]"))), "$", "array<variant>"
    )
    score = F.aggregate(
        arr, F.lit(0), lambda acc, x: acc + F.when(F.schema_of_variant(x).rlike(r"^OBJECT<.+>$"), 1).otherwise(2)
    )
    return F.coalesce(score == 1, F.lit(False))


def field(obj: Column, key: str) -> Column:
    return F.try_variant_get(obj, f"$.{key}", "variant")


def numeric_value(v: Column) -> Column:
    """Score usable for the per-target average: JSON number/boolean only (``v`` = field variant)."""
    return F.when(F.schema_of_variant(v).rlike(NUMERIC_TYPES), F.try_variant_get(v, "$", "double"))


def row_value(v: Column) -> Column:
    """Score written on the evaluation row: missing -> 0.5, null -> null, else coerced."""
    as_double = F.try_variant_get(v, "$", "double")
    return F.when(v.isNull(), F.lit(DEFAULT_SCORE)).otherwise(F.nanvl(as_double, F.lit(None).cast("double")))


def text_value(v: Column) -> Column:
    """Text field with '' for a missing key (JSON null stays null)."""
    return F.when(v.isNull(), F.lit("")).otherwise(F.try_variant_get(v, "$", "string"))


def parse_judgments(df, raw: str = "raw_text", metrics=METRICS, keep=()):
    """Add ``status``, row scores, ``num_<m>`` scores, ``reasoning`` and ``notes``.

    Staged projections keep each expensive expression single: the block is cut
    once, parsed once into a VARIANT, each field is looked up once, and the typed
    scores are read from those field columns (Catalyst does not inline a
    non-trivial expression that is referenced more than once).
    """
    keep = [F.col(c) for c in keep]
    s3 = parsed_fields(df, raw, list(metrics) + ["reasoning", "notes"], keep)
    ok = F.col("status") == "ok"
    cols = keep + [F.col("status")]
    cols += [F.when(ok, row_value(F.col(f"_v_{m}"))).alias(m) for m in metrics]
    cols += [F.when(ok, numeric_value(F.col(f"_v_{m}"))).alias(f"num_{m}") for m in metrics]
    cols += [F.when(ok, text_value(F.col(f"_v_{k}"))).alias(k) for k in ("reasoning", "notes")]
    return s3.select(*cols)


def parsed_fields(df, raw: str, fields, keep):
    """``keep``, ``status`` and the named fields as VARIANT (``_v_<field>``), from one staged parse."""
    s1 = df.select(*keep, json_block(F.col(raw)).alias("_block"))
    s1 = s1.select(
        *keep, "_block",
        F.when(F.col("_block") != "", F.try_parse_json(F.concat(F.lit("["), F.col("_block"), F.lit("]")))).alias("_arr"),
    )
    # Exactly one JSON value inside the block: the wrapper array has no second element.
    s2 = s1.select(
        *keep, "_block",
        F.when(
            F.try_variant_get("_arr", "$[1]", "variant").isNull(), F.try_variant_get("_arr", "$[0]", "variant")
        ).alias("_obj"),
    )
    return s2.select(
        *keep,
        parse_status(F.col("_block"), F.col("_obj")).alias("status"),
        *[field(F.col("_obj"), k).alias(f"_v_{k}") for k in fields],
    )


def value_kind(v: Column) -> Column:
    """Kind of a metric value: number, boolean, numeric_string, text, null, missing or other."""
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit("missing"))
        .when(F.is_variant_null(v), F.lit("null"))
        .when(t == "BOOLEAN", F.lit("boolean"))
        .when(t.rlike(NUMERIC_TYPES), F.lit("number"))
        .when((t == "STRING") & F.try_variant_get(v, "$", "double").isNotNull(), F.lit("numeric_string"))
        .when(t == "STRING", F.lit("text"))
        .otherwise(F.lit("other"))
    )


def judgment_issues(df, raw: str = "raw_text", metrics=METRICS, keep=()):
    """JSN-4 issue flags: one row per usable judgment and metric whose value is not a plain number (one parse)."""
    keep = [F.col(c) for c in keep]
    s3 = parsed_fields(df, raw, metrics, keep)
    kinds = F.array(*[F.struct(F.lit(m).alias("metric"), value_kind(F.col(f"_v_{m}")).alias("kind")) for m in metrics])
    # judgments that are not usable have no entry; the filter stays above the parse
    rows = s3.select(*keep, F.inline(F.when(F.col("status") == "ok", F.filter(kinds, lambda k: k["kind"] != "number"))))
    return rows
