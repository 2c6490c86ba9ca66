"""Search context: real-time gate, top hits, snippet text (TOP-4, STR-6/7/8/18, JN-5, AGG-19, SRC-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import NO_SEARCH_RESULTS, SEARCH_HIT_TEMPLATE, SEARCH_HITS
from ..functions.text import fill, realtime_flag

HIT_SCHEMA = "array<struct<title:string,snippet:string,link:string>>"


def hits_from_json(df: DataFrame, col: str = "items_json", key: str = "prompt_id") -> DataFrame:
    """SRC-6: search response JSON (list of items) -> ranked rows; missing field -> ''."""
    items = df.select(key, F.posexplode(F.from_json(F.col(col), HIT_SCHEMA)).alias("pos", "item"))
    return items.select(
        key,
        (F.col("pos") + 1).alias("rk"),
        *[F.coalesce(F.col(f"item.{c}"), F.lit("")).alias(c) for c in ("title", "snippet", "link")],
    )


def top_hits(hits: DataFrame, k: int = SEARCH_HITS, key: str = "prompt_id") -> DataFrame:
    """TOP-4: first ``k`` hits per query by rank (planned as a WindowGroupLimit)."""
    w = Window.partitionBy(key).orderBy("rk")
    return hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def snippet_text(hits: DataFrame, key: str = "prompt_id") -> DataFrame:
    """STR-8 + AGG-19: hits rendered and joined by a blank line in rank order."""
    one = hits.select(key, "rk", fill(SEARCH_HIT_TEMPLATE, title=F.col("title"), snippet=F.col("snippet"), link=F.col("link")).alias("t"))
    return one.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "t"))), lambda x: x["t"]), "\n\n").alias("snippets")
    )


def search_context(gate: DataFrame, hits: DataFrame, key: str = "prompt_id") -> DataFrame:
    """JN-5 + STR-7/18: search text for gated queries, null for the others.

    ``gate`` has (key, raw_text) classifier answers and optional ``is_ats``;
    searching happens only for non-ATS real-time queries. A gated query without
    hits gets the no-result text.
    """
    is_ats = F.col("is_ats") if "is_ats" in gate.columns else F.lit(False)
    g = gate.select(key, realtime_flag(F.col("raw_text")).alias("realtime"), is_ats.alias("is_ats"))
    texts = snippet_text(top_hits(hits, key=key), key)
    j = g.join(texts, key, "left")
    searched = F.col("realtime") & ~F.col("is_ats")
    results = F.when(searched, F.coalesce(F.col("snippets"), F.lit(NO_SEARCH_RESULTS)))
    return j.select(
        key, "realtime", results.alias("search_results"),
        F.coalesce(F.when(results != "", results), F.lit("N/A")).alias("displayed"),
    )
