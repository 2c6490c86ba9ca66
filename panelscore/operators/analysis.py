"""Offline analysis of an evaluation table (AGG-1..12, AGG-21, TOP-1/2, PRJ-4/5/6, SNK-5).

All aggregates skip nulls, ``std`` is the sample deviation, and rounding is
half-even to three decimals (MTH-2: ``bround``, which equals NumPy/pandas
rounding of the scaled value). Null group keys are dropped (FLT-10; per grouping
set when several are computed in one scan), as a pandas groupby does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..config import CORE4


# --------------------------------------------------------------------------- format dispatch


def eval_format(df: DataFrame) -> str:
    """PRJ-6: 'comprehensive' (target_model + evaluator), 'simple' (model) or 'unknown'."""
    cols = set(df.columns)
    if {"target_model", "evaluator"} <= cols:
        return "comprehensive"
    if "model" in cols:
        return "simple"
    return "unknown"


def numeric_columns(df: DataFrame) -> list[str]:
    """PRJ-5: numeric columns (booleans and timestamps excluded)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def overview(df: DataFrame) -> DataFrame:
    """PRJ-4 / AGG-17: row count and column count of the evaluation table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"))


# --------------------------------------------------------------------------- grouped statistics


def _mean(m):
    return F.bround(F.avg(m), 3).alias(f"{m}_mean")


def _std(m):
    return F.bround(F.stddev_samp(m), 3).alias(f"{m}_std")


def group_stats(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str] = CORE4, std: bool = True, count_of: str | None = None
) -> DataFrame:
    """AGG-1/2/3/4/7: mean (and std) of ``metrics`` per key; null keys dropped."""
    keys = list(keys)
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    aggs = []
    for m in metrics:
        aggs.append(_mean(m))
        if std:
            aggs.append(_std(m))
        if count_of == m:
            aggs.append(F.count(m).alias(f"{m}_count"))
    return df.where(cond).groupBy(*keys).agg(*aggs)


def model_stats(df: DataFrame) -> DataFrame:
    """AGG-1 + AGG-7: per target model mean/std of the core metrics, helpfulness count."""
    return group_stats(df, ["target_model"], count_of="helpfulness")


def evaluator_stats(df: DataFrame) -> DataFrame:
    """AGG-2: per evaluator mean/std (judge bias)."""
    return group_stats(df, ["evaluator"])


def cross_eval(df: DataFrame) -> DataFrame:
    """AGG-3: mean per (target model, evaluator)."""
    return group_stats(df, ["target_model", "evaluator"], std=False)


def simple_stats(df: DataFrame) -> DataFrame:
    """AGG-4: per ``model`` mean/std for the simple table layout."""
    if eval_format(df) != "simple":
        raise ValueError("simple layout needs a 'model' column and no target_model/evaluator pair")
    return group_stats(df, ["model"])


def stats_grouping_sets(df: DataFrame, metrics: Sequence[str] = CORE4) -> DataFrame:
    """AGG-21: model, evaluator and cross statistics in one scan (GROUPING SETS).

    Null keys are removed per set after aggregation: a row with a null target
    still counts for its evaluator.
    """
    aggs = []
    for m in metrics:
        aggs += [_mean(m), _std(m)]
    g = df.groupingSets(
        [["target_model"], ["evaluator"], ["target_model", "evaluator"]], "target_model", "evaluator"
    ).agg(*aggs, F.grouping_id().alias("_gid"))
    # grouping_id bit 1 = target_model aggregated away, bit 0 = evaluator aggregated away
    name = (
        F.when(F.col("_gid") == 1, F.lit("target_model"))
        .when(F.col("_gid") == 2, F.lit("evaluator"))
        .otherwise(F.lit("target_model,evaluator"))
    )
    keep = ~(((F.col("_gid").bitwiseAND(2)) == 0) & F.col("target_model").isNull()) & ~(
        ((F.col("_gid").bitwiseAND(1)) == 0) & F.col("evaluator").isNull()
    )
    return g.where(keep).select(name.alias("grouping"), "target_model", "evaluator", *[c for c in g.columns if c.endswith(("_mean", "_std"))])


# --------------------------------------------------------------------------- overall scores and top-k


def _overall(means: Sequence[str]):
    arr = F.filter(F.array(*[F.col(c) for c in means]), lambda x: x.isNotNull())
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(arr).cast("double"))


def overall_by(df: DataFrame, key: str, metrics: Sequence[str] = CORE4) -> DataFrame:
    """AGG-8: unrounded macro average (mean of the metric means, nulls skipped) per key."""
    means = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.avg(m).alias(f"_m_{m}") for m in metrics])
    return means.select(key, _overall([f"_m_{m}" for m in metrics]).alias("overall"))


def overall_scores(df: DataFrame, metrics: Sequence[str] = CORE4) -> DataFrame:
    """AGG-8 for targets and evaluators as one long table (rounded to 6 for display), in one scan."""
    means = [F.avg(m).alias(f"_m_{m}") for m in metrics]
    g = df.groupingSets([["target_model"], ["evaluator"]], "target_model", "evaluator").agg(*means, F.grouping("evaluator").alias("_by_target"))
    kind = F.when(F.col("_by_target") == 1, F.lit("target_model")).otherwise(F.lit("evaluator"))
    name = F.when(F.col("_by_target") == 1, F.col("target_model")).otherwise(F.col("evaluator"))
    named = g.select(kind.alias("kind"), name.alias("name"), _overall([f"_m_{m}" for m in metrics]).alias("overall"))
    return named.where(F.col("name").isNotNull()).select("kind", "name", F.bround("overall", 6).alias("overall"))


def _arg(key: str, score: str, best: bool):
    """Arg-max/min with ties resolved to the first key in sorted order (TOP-1/TOP-2)."""
    order = F.struct((-F.col(score)) if best else F.col(score), F.col(key))
    return F.min_by(F.col(key), order)


def best_model(df: DataFrame) -> DataFrame:
    """AGG-9: best target model by overall score (one row)."""
    o = overall_by(df, "target_model").where(F.col("overall").isNotNull())
    best = o.agg(_arg("target_model", "overall", True).alias("best_model"), F.bround(F.max("overall"), 3).alias("score"))
    return best.where(F.col("best_model").isNotNull())  # no data -> no row (FLT-9)


def lenient_strict(df: DataFrame) -> DataFrame:
    """AGG-10: most lenient (highest overall) and most strict (lowest) evaluator."""
    o = overall_by(df, "evaluator").where(F.col("overall").isNotNull())
    picks = o.agg(
        _arg("evaluator", "overall", True).alias("most_lenient"),
        F.bround(F.max("overall"), 3).alias("lenient_score"),
        _arg("evaluator", "overall", False).alias("most_strict"),
        F.bround(F.min("overall"), 3).alias("strict_score"),
    )
    return picks.where(F.col("most_lenient").isNotNull())  # no data -> no row (FLT-9)


def metric_extremes(df: DataFrame, best: bool, metrics: Sequence[str] = CORE4) -> DataFrame:
    """AGG-11 (best=True) / AGG-12: per metric the best/worst model and its mean."""
    means = df.where(F.col("target_model").isNotNull()).groupBy("target_model").agg(
        *[F.avg(m).alias(m) for m in metrics]
    )
    long = means.unpivot("target_model", list(metrics), "metric", "mean").where(F.col("mean").isNotNull())
    agg = long.groupBy("metric").agg(
        _arg("target_model", "mean", best).alias("target_model"),
        (F.max("mean") if best else F.min("mean")).alias("score"),
    )
    return agg.select(F.initcap("metric").alias("metric"), "target_model", F.bround("score", 3).alias("score"))


# --------------------------------------------------------------------------- report (SNK-5)

REPORT_COLUMNS = ["section", "item", "metric", "value", "label"]


def _report_facts(df: DataFrame, metrics: Sequence[str] = CORE4) -> DataFrame:
    """One scan: statistics per target model, per evaluator, and the grand total.

    Output rows (kind, item, <m>_mean_raw, <m>_mean, <m>_std, helpfulness_count, n_rows);
    everything in the report is derived from this small table.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count("helpfulness").alias("helpfulness_count")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean_raw"), F.stddev_samp(m).alias(f"{m}_std_raw")]
    g = df.groupingSets([["target_model"], ["evaluator"], []], "target_model", "evaluator").agg(
        *aggs, F.grouping_id().alias("_gid")
    )
    kind = (F.when(F.col("_gid") == 1, F.lit("target_model"))
            .when(F.col("_gid") == 2, F.lit("evaluator")).otherwise(F.lit("total")))
    item = F.when(F.col("_gid") == 1, F.col("target_model")).when(F.col("_gid") == 2, F.col("evaluator"))
    out = g.select(kind.alias("kind"), item.alias("item"), "n_rows", "helpfulness_count",
                   *[F.col(f"{m}_mean_raw") for m in metrics], *[F.col(f"{m}_std_raw") for m in metrics])
    # null keys are dropped per grouping set (the total keeps every row)
    return out.where((F.col("kind") == "total") | F.col("item").isNotNull())


def report_long(df: DataFrame, metrics: Sequence[str] = CORE4) -> DataFrame:
    """SNK-5: the evaluation report as a long table (section, item, metric, value, label).

    The input is scanned once (grouping sets); the sections, best model,
    lenient/strict judges and per-metric leaders are derived from that small
    result, which holds one row per model, per judge and the total.
    """
    if eval_format(df) != "comprehensive":
        ov = df.agg(F.count(F.lit(1)).cast("double").alias("value")).where(F.col("value") > 0)
        return ov.select(F.lit("overview").alias("section"), F.lit("dataset").alias("item"),
                         F.lit("total_records").alias("metric"), "value", F.lit(None).cast("string").alias("label"))
    from ..session import materialize

    # one scan of the input; the small result feeds every section
    facts = materialize(_report_facts(df, metrics), "report_facts")
    none = F.lit(None).cast("string")
    total = facts.where((F.col("kind") == "total") & (F.col("n_rows") > 0))  # empty input -> empty report
    entries = [
        total.select(F.lit("overview"), F.lit("dataset"), F.lit("total_records"), F.col("n_rows").cast("double"), none),
        total.select(F.lit("overview"), F.lit("dataset"), F.lit("n_columns"), F.lit(float(len(df.columns))),
                     F.lit(", ".join(df.columns))),
    ]
    for kind, section, with_count in (("target_model", "model_performance", True), ("evaluator", "evaluator_analysis", False)):
        part = facts.where(F.col("kind") == kind)
        stats = []
        for m in metrics:
            stats += [(f"{m}_mean", F.bround(f"{m}_mean_raw", 3)), (f"{m}_std", F.bround(f"{m}_std_raw", 3))]
            if with_count and m == "helpfulness":
                stats.append(("helpfulness_count", F.col("helpfulness_count").cast("double")))
        arr = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in stats])
        entries.append(part.select(F.lit(section), F.col("item"), F.inline(arr), none))
    overall = facts.where(F.col("kind") != "total").select(
        "kind", "item", *[F.col(f"{m}_mean_raw").alias(m) for m in metrics]
    ).select("kind", "item", *metrics, _overall(list(metrics)).alias("overall"))
    picks = overall.where(F.col("overall").isNotNull()).groupBy("kind").agg(
        _arg("item", "overall", True).alias("top"), F.max("overall").alias("top_score"),
        _arg("item", "overall", False).alias("bottom"), F.min("overall").alias("bottom_score"),
    )
    entries.append(picks.where(F.col("kind") == "target_model").select(
        F.lit("model_performance"), F.lit("best_model"), F.lit("overall"), F.bround("top_score", 3), F.col("top")))
    ev = picks.where(F.col("kind") == "evaluator")
    entries.append(ev.select(F.lit("evaluator_analysis"), F.lit("most_lenient"), F.lit("overall"), F.bround("top_score", 3), F.col("top")))
    entries.append(ev.select(F.lit("evaluator_analysis"), F.lit("most_strict"), F.lit("overall"), F.bround("bottom_score", 3), F.col("bottom")))
    long = overall.where(F.col("kind") == "target_model").unpivot("item", list(metrics), "metric", "mean").where(F.col("mean").isNotNull())
    leaders = long.groupBy("metric").agg(
        _arg("item", "mean", True).alias("best"), F.max("mean").alias("best_score"),
        _arg("item", "mean", False).alias("worst"), F.min("mean").alias("worst_score"),
    )
    entries.append(leaders.select(F.lit("insights"), F.lit("strength"), F.initcap("metric"), F.bround("best_score", 3), F.col("best")))
    entries.append(leaders.select(F.lit("insights"), F.lit("weakness"), F.initcap("metric"), F.bround("worst_score", 3), F.col("worst")))
    out = None
    for e in entries:
        e = e.toDF(*REPORT_COLUMNS)
        out = e if out is None else out.unionByName(e)
    return out


def report_text(report: DataFrame, columns: Sequence[str], source: str, generated: str, metrics: Sequence[str] = CORE4) -> DataFrame:
    """SNK-5: ``report_long`` as the numbered lines of the report (``line_no, value``); no data, no lines.

    Title, time and source, overview, a line per model and per judge in name order, best model, most
    lenient and strict judge, strengths and weaknesses in metric order. ``columns``: of the analysed
    table; ``generated``: the report's time as text (never taken inside a plan).
    """
    from .joins import numbered

    cell = lambda c: F.when(F.col(c).isNull(), "NaN").otherwise(F.format_string("%.3f", c))
    n = F.format_string("%d", F.col("value").cast("long"))
    total = report.where("metric = 'total_records'")
    judged = {"target_model", "evaluator"} <= set(columns)
    fixed = [
        (0, F.lit("LLM EVALUATION ANALYSIS REPORT")), (1, F.lit("=" * 50)), (2, F.lit(f"Generated: {generated}")), (3, F.lit(f"Data source: {source}")),
        (4, F.concat(F.lit("Total records: "), n)), (5, F.lit("")),
        (10, F.lit("DATASET OVERVIEW")), (11, F.lit("-" * 20)), (12, F.concat(F.lit("Shape: ("), n, F.lit(f", {len(columns)})"))),
        (13, F.lit(f"Columns: {list(columns)}")), (14, F.lit("")),
        (70, F.lit("KEY INSIGHTS")), (71, F.lit("-" * 15)), (92, F.lit("")), (93, F.lit("=" * 50)), (94, F.lit("Report generation completed.")),
    ]
    sections = []
    if judged:
        sections = [
            ("model_performance", 20, "MODEL PERFORMANCE SUMMARY", 30, "target_model", True),
            ("evaluator_analysis", 50, "EVALUATOR ANALYSIS", 20, "evaluator", False),
        ]
        fixed += [(72, F.lit("Model Strengths:")), (80, F.lit("")), (81, F.lit("Model Weaknesses:"))]
    parts = []
    for section, at, title, dashes, key, counted in sections:
        names = [f"{m}_{s}" for m in metrics for s in (("mean", "std", "count") if counted and m == "helpfulness" else ("mean", "std"))]
        fixed += [(at, F.lit(title)), (at + 1, F.lit("-" * dashes)), (at + 2, F.lit(" ".join([key, *names]))), (at + 4, F.lit("")), (at + 9, F.lit(""))]
        rows = report.where((F.col("section") == section) & F.col("label").isNull())
        by_item = rows.groupBy("item").agg(*[F.max(F.when(F.col("metric") == x, F.col("value"))).alias(x) for x in names])
        cells = [F.format_string("%d", F.col(x).cast("long")) if x.endswith("_count") else cell(x) for x in names]
        parts.append(by_item.select(F.lit(at + 3).alias("at"), F.col("item").alias("item"), F.concat_ws(" ", "item", *cells).alias("value")))
    picks = [
        ("best_model", 25, F.concat(F.lit("Best performing model (overall): "), "label")), ("best_model", 26, F.concat(F.lit("Average score: "), cell("value"))),
        ("most_lenient", 55, F.concat(F.lit("Most lenient evaluator: "), "label")), ("most_strict", 56, F.concat(F.lit("Most strict evaluator: "), "label")),
    ]
    for item, at, text in picks:
        parts.append(report.where((F.col("item") == item) & F.col("label").isNotNull()).select(F.lit(at).alias("at"), F.lit("").alias("item"), text.alias("value")))
    place = {m.capitalize(): f"{i:03d}" for i, m in enumerate(metrics)}
    order = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    for item, at in (("strength", 73), ("weakness", 82)):
        text = F.concat(F.lit("  "), "metric", F.lit(": "), "label", F.lit(" ("), cell("value"), F.lit(")"))
        parts.append(report.where(F.col("item") == item).select(F.lit(at).alias("at"), order[F.col("metric")].alias("item"), text.alias("value")))
    lines = total.select(F.inline(F.array(*[F.struct(F.lit(at).alias("at"), F.lit("").alias("item"), text.alias("value")) for at, text in fixed])))
    for part in parts:
        lines = lines.unionByName(part)
    return numbered(lines, ["at", "item"], "line_no").select("line_no", "value")


def evaluation_view(evals: DataFrame, enabled: bool = True) -> DataFrame:
    """PRJ-3: the evaluation table shown to the user; empty (same schema) when disabled."""
    from ..config import METRICS

    view = evals.select("target_model", "evaluator", *METRICS)
    return view if enabled else view.limit(0)


def display_sorted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SRT-1: grouped outputs in key order, for display only (a global sort)."""
    return df.orderBy(*[F.asc_nulls_last(k) for k in keys])
