"""Chart data: cross pivot, correlation matrix, box-plot statistics, heat-map/radar/bar tables.

Drawing is left to the caller; these operators produce the numbers behind
each chart (AGG-6, AGG-13..16, RSH-1..3).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CORE4, METRICS
from ..session import materialize
from .analysis import numeric_columns
from .joins import bounded_broadcast, spread

#: Largest table of groups and wanted ranks that is broadcast (a handful of short rows per group).
RANKS_BROADCAST_ROWS = 100_000
#: Most judges that the pivot turns into columns.
MAX_JUDGES = 1000


def cross_pivot(df: DataFrame, evaluators: Sequence[str] | None = None, metric: str = "helpfulness") -> DataFrame:
    """AGG-13: mean ``metric`` with rows = target model, columns = evaluator.

    Without ``evaluators`` the columns are all judges with a value (one small
    distinct job; judges are a panel). The pivot is a single grouped aggregation of
    conditional averages. Rows whose cells are all null are dropped; a target
    never judges itself, so its own cell is null.
    """
    if evaluators is None:
        found = df.where(F.col("evaluator").isNotNull() & F.col("target_model").isNotNull() & F.col(metric).isNotNull())
        rows = found.select("evaluator").distinct().limit(MAX_JUDGES + 1).collect()
        if len(rows) > MAX_JUDGES:
            raise ValueError(f"more than {MAX_JUDGES} evaluators: name those wanted as columns")
        evaluators = sorted(r[0] for r in rows)
    if not evaluators:
        return df.select("target_model").limit(0)
    # conditional averages: one aggregation (``pivot`` would aggregate twice)
    p = (
        df.where(F.col("target_model").isNotNull() & F.col("evaluator").isNotNull())
        .groupBy("target_model")
        .agg(*[F.bround(F.avg(F.when(F.col("evaluator") == e, F.col(metric))), 3).alias(e) for e in evaluators])
    )
    any_value = None
    for e in evaluators:
        c = F.col(f"`{e}`").isNotNull()
        any_value = c if any_value is None else any_value | c
    return p.where(any_value)


def correlation_long(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """AGG-14: Pearson correlation of every pair of numeric columns, pairwise complete.

    One scan: each row becomes one entry per column pair whose two values it holds, and built-in
    moments are aggregated per pair with map-side partial sums, so the shuffle carries
    one row per pair and task. A pair whose complete rows are constant in either column, or a
    single row, gives null. Output: (a, b, r) for all ordered pairs, diagonal included.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    x = [f"cast(`{c}` as double)" for c in cols]
    cells = ", ".join(f"struct({k} as k, {x[i]} as x, {x[j]} as y)" for k, (i, j) in enumerate(pairs))
    each = spread(df.select(*[f"`{c}`" for c in cols])).selectExpr(f"inline(array({cells}))").where("x is not null and y is not null")
    varying = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    r = F.bround(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")), digits)
    moments = each.groupBy("k").agg(F.when(varying, r).alias("r"))
    # names of the pairs, as literals of a map of the pair's number
    name = lambda side: F.element_at(F.array(*[F.lit(cols[p[side]]) for p in pairs]), F.col("k") + 1)
    named = moments.select(name(0).alias("a"), name(1).alias("b"), "r")
    named = named.select("a", "b", F.when((F.col("a") == F.col("b")) & F.col("r").isNotNull(), 1.0).otherwise(F.col("r")).alias("r"))
    ways = F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    return named.select(F.inline(F.when(F.col("a") == F.col("b"), F.slice(ways, 1, 1)).otherwise(ways)))


def _by_metric(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.where(F.col(key).isNotNull()).select(key, F.inline(cells)).where(F.col("value").isNotNull())


def order_statistics(hist: DataFrame, group: Sequence[str], ranks: DataFrame) -> DataFrame:
    """Values at given 0-based ranks of every group of a written histogram, exact.

    ``hist``: ``group``, ``value``, ``cnt`` and ``part``, the number of the row's range when the
    histogram was dealt by (group, value); ``ranks``: ``group`` and ``rank``. Rows per range are
    counted and summed up over the ranges (one small row per group and range). Only ranges that hold
    a wanted rank are read again, each on its own: no task sees a whole group.
    """
    group = list(group)
    each = hist.groupBy(*group, "part").agg(F.sum("cnt").alias("c"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*group, "part", "c", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    # a few ranks per group: joined to the ranges that hold them
    held = each.join(bounded_broadcast(ranks, RANKS_BROADCAST_ROWS), group).where("before <= rank and rank < before + c")
    wanted = held.groupBy(*group, "part", "before").agg(F.collect_set("rank").alias("ranks"))
    near = hist.join(bounded_broadcast(wanted, RANKS_BROADCAST_ROWS), [*group, "part"])
    up_to = Window.partitionBy(*group, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.select(*group, "value", "cnt", "ranks", (F.col("before") + F.sum("cnt").over(up_to)).alias("upto"))
    inside = F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("cnt")))
    return near.select(*group, "value", F.explode(inside).alias("rank"))


def box_stats(df: DataFrame, key: str, metrics: Sequence[str] = CORE4, whisker: float = 1.5) -> DataFrame:
    """AGG-15/16: box-plot numbers per (key, metric), exact, also for continuous scores.

    One scan builds a value histogram per (key, metric, value) with map-side partial counts,
    dealt by ranges of (key, metric, value) and written once. The quartiles (linear
    interpolation between order statistics) are read from the ranges that hold their ranks;
    whiskers (most extreme values within ``whisker`` x IQR of the quartiles) and outlier counts
    are a second aggregation over the histogram.
    """
    spark = df.sparkSession
    group = [key, "metric"]
    hist = _by_metric(df, key, metrics).groupBy(*group, "value").agg(F.count(F.lit(1)).alias("cnt"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hist = materialize(hist.repartitionByRange(ranges, *group, "value").withColumn("part", F.spark_partition_id()), "histogram")
    sizes = hist.groupBy(*group).agg(F.sum("cnt").alias("n"))
    quantiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    at = {name: (F.col("n") - 1) * q for name, q in quantiles.items()}
    needed = F.array(*[f(h).cast("long") for h in at.values() for f in (F.floor, F.ceil)])
    stats = order_statistics(hist, group, sizes.select(*group, F.explode(F.array_distinct(needed)).alias("rank")))
    by_rank = stats.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))
    quart = sizes.join(by_rank, group)
    for name, h in at.items():
        low, high = (F.element_at("v", f(h).cast("long")) for f in (F.floor, F.ceil))
        quart = quart.withColumn(name, low + (high - low) * (h - F.floor(h)))
    quart = quart.select(*group, "n", *quantiles, (F.col("q3") - F.col("q1")).alias("iqr"))
    j = hist.join(bounded_broadcast(quart, RANKS_BROADCAST_ROWS), group)
    lo_fence = F.col("q1") - whisker * F.col("iqr")
    hi_fence = F.col("q3") + whisker * F.col("iqr")
    inside = (F.col("value") >= lo_fence) & (F.col("value") <= hi_fence)
    out = j.groupBy(*group, "n", *quantiles, "iqr").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.sum(F.when(~inside, F.col("cnt")).otherwise(F.lit(0))).alias("n_outliers"),
    )
    return out.select(
        key, "metric", "n",
        *[F.bround(c, 6).alias(c) for c in ("q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi")],
        F.col("n_outliers").cast("long").alias("n_outliers"),
    )


def metric_means(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """AGG-6 / RSH-2: unrounded mean of every metric per target model (heat-map matrix)."""
    return df.where(F.col("target_model").isNotNull()).groupBy("target_model").agg(*[F.avg(m).alias(m) for m in metrics])


def heatmap(df: DataFrame, digits: int = 6) -> DataFrame:
    m = metric_means(df)
    return m.select("target_model", *[F.bround(c, digits).alias(c) for c in METRICS])


def radar(df: DataFrame, digits: int = 6) -> DataFrame:
    """RSH-3: per model the 8 metric means as (position, label, value) rows."""
    m = metric_means(df)
    arr = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(c).alias("theta"), F.bround(F.col(c), digits).alias("r"))
                    for i, c in enumerate(METRICS)])
    return m.select("target_model", F.inline(arr))


def bar_long(df: DataFrame, digits: int = 6) -> DataFrame:
    """RSH-1: melt of the per-model means to (target_model, variable, value); nulls kept."""
    m = heatmap(df, digits)
    return m.unpivot("target_model", list(METRICS), "variable", "value")
