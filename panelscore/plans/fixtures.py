"""Derived evaluation inputs built from the given tables (Spark side).

Each builder is a lazy DataFrame over the parquet tables, so its work grows with
them. The same tables are defined for the oracle as SQL in ``plans.oracle``;
the two definitions are written independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_PANEL, METRICS
from ..functions.panel import others, panel_array
from ..operators.joins import dealt
from ..sources.tables import read_table

TURNS = 1_000_000  # more than any conversation's turns, so (conv_id, turn) has a number of its own


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: a user turn answered by the next (assistant) turn of the same conversation.

    Joined on (conv_id, turn) rather than windowed by conv_id, so one very long
    conversation cannot land in a single task.
    """
    conv = read_table(spark, sf_dir, "conversations")
    user = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    asst = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return user.join(asst, ["conv_id", "turn"]).select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("prompt_id"), "prompt", "answer"
    )


def responses(spark: SparkSession, sf_dir: str, models=DEFAULT_PANEL) -> DataFrame:
    """B3: one answer per prompt x model (the whole answer, signed by the model), with blanks and error sentinels."""
    p = prompts(spark, sf_dir)
    fan = p.select("prompt_id", "prompt", "answer", F.inline(panel_array(models)))
    k = (F.col("prompt_id") * 3 + F.col("i")) % 29
    signed = F.concat("answer", F.repeat(F.concat(F.lit(" "), F.col("model")), F.col("i") + 1))
    return fan.select(
        "prompt_id",
        "prompt",
        "model",
        F.col("i").alias("model_idx"),
        F.when(k == 0, F.lit(""))
        .when(k == 1, F.concat(F.lit("["), F.col("model"), F.lit(" Error] timeout")))
        .otherwise(signed)
        .alias("response"),
        F.concat(F.lit("because "), F.col("model")).alias("reasoning"),
    )


def judgments_raw(spark: SparkSession, sf_dir: str, models=DEFAULT_PANEL) -> DataFrame:
    """B4: noisy judge output for every ordered (target, evaluator) pair, fault class ``f``."""
    # a few bytes a prompt become many judgments: dealt out before they fan out, as no size of a scan or shuffle tells it
    p = dealt(prompts(spark, sf_dir).select("prompt_id"))
    arr = panel_array(models)
    t = p.select("prompt_id", F.inline(arr)).select(
        "prompt_id", F.col("i").alias("t"), F.col("model").alias("target_model"),
        others(arr, F.col("model")).alias("judges"),
    )
    pairs = t.select("prompt_id", "t", "target_model", F.inline("judges")).select(
        "prompt_id", "t", "target_model", F.col("i").alias("e"), F.col("model").alias("evaluator")
    )
    f = (F.col("prompt_id") * 7 + 3 * F.col("t") + 5 * F.col("e")) % 23
    b = F.col("prompt_id") * 31 + F.col("t") * 17 + F.col("e") * 7
    pairs = pairs.select("prompt_id", "target_model", "evaluator", f.alias("f"), b.alias("b"))

    def val(k):
        # Spark prints doubles the way the judge text expects ("0.37", "1.0").
        return ((F.col("b") + 13 * k) % 101 / F.lit(100.0)).cast("string")

    parts = []
    for k, m in enumerate(METRICS):
        text = F.concat(F.lit(f'"{m}": '), val(k))
        if m == "helpfulness":
            text = F.when(F.col("f") == 2, F.lit('"extra": 1')).otherwise(text)
        elif m == "correctness":
            text = F.when(F.col("f") == 3, F.lit('"correctness": null')).otherwise(text)
        elif m == "coherence":
            text = F.when(F.col("f") == 4, F.lit('"coherence": "0.8"')).otherwise(text)
        elif m == "clarity":
            text = F.when(F.col("f") == 5, F.lit('"clarity": true')).otherwise(text)
        parts.append(text)
    obj = F.concat(F.lit("{"), F.concat_ws(", ", *parts, F.lit('"reasoning": "ok"'), F.lit('"notes": ""')), F.lit("}"))
    f = F.col("f")

    def wrap(o):
        # ``o`` is bound once (lambda variable), so the object text is built once per row.
        return (
            F.when(f == 0, F.lit("I cannot score this."))
            .when(f == 1, F.concat(F.lit("Scores: "), o.substr(F.lit(1), F.length(o) - 2), F.lit("}")))
            .when(f == 6, F.lit("{}"))
            .when(f == 7, F.concat(o, F.lit(" or "), o))
            .otherwise(F.concat(F.lit("Here is my evaluation: "), o, F.lit(" Thanks.")))
        )

    raw = F.element_at(F.transform(F.array(obj), wrap), 1)
    return pairs.select("prompt_id", "target_model", "evaluator", "f", "b", raw.alias("raw_text"))


def eval_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5: wide typed evaluation table, one row per lineitem (nulls, outliers, null targets)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("prompt_id"),
        F.col("l_linenumber").alias("line_no"),
        (F.col("l_partkey") % 3).alias("t"),
        ((F.col("l_partkey") % 3 + 1 + F.col("l_suppkey") % 2) % 3).alias("e"),
        (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17 + F.col("l_partkey") * 7).alias("b"),
        F.col("l_shipdate").alias("eval_ts"),
    )
    letter = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    cols = [
        "prompt_id",
        "line_no",
        F.when(F.col("prompt_id") % 997 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("model_"), F.element_at(letter, (F.col("t") + 1).cast("int"))))
        .alias("target_model"),
        F.concat(F.lit("model_"), F.element_at(letter, (F.col("e") + 1).cast("int"))).alias("evaluator"),
    ]
    for k, m in enumerate(METRICS):
        key = F.col("prompt_id") + k
        cols.append(
            F.when(key % 50 == 0, F.lit(None).cast("double"))
            .when(key % 37 == 0, ((F.col("b") + 11 * k) % 11) / F.lit(100.0))
            .otherwise(
                (60 + 5 * ((F.col("t") + k) % 3) + 2 * F.col("e") + (F.col("b") + 11 * k) % 26) / F.lit(100.0)
            )
            .alias(m)
        )
    cols.append("eval_ts")
    return li.select(*cols)


def ats_raw(spark: SparkSession, sf_dir: str, models=DEFAULT_PANEL) -> DataFrame:
    """B6: whole-string JSON of the ATS scorer, fault class ``f``."""
    p = prompts(spark, sf_dir).select("prompt_id", F.inline(panel_array(models)))
    a = p.select(
        "prompt_id",
        "model",
        ((F.col("prompt_id") * 5 + F.col("i")) % 11).alias("f"),
        ((F.col("prompt_id") * 37 + F.col("i") * 11) % 101).alias("score"),
    )
    f = F.col("f")
    obj = F.concat(
        F.lit("{"),
        F.when(f == 2, F.lit(""))
        .when(f == 5, F.lit('"ats_score": null, '))
        .when(f == 6, F.concat(F.lit('"ats_score": '), F.col("score").cast("string"), F.lit(".5, ")))
        .when(f == 7, F.lit('"ats_score": true, '))
        .otherwise(F.concat(F.lit('"ats_score": '), F.col("score").cast("string"), F.lit(", "))),
        F.when(f == 3, F.lit('"strengths": null, '))
        .when(f == 4, F.lit(""))
        .when(f == 8, F.lit('"strengths": "sql", '))
        .otherwise(F.lit('"strengths": ["sql", "spark"], ')),
        F.lit('"gaps": ["scala"], "suggestions": ["add dates", "quantify"]}'),
    )
    raw = F.when(f == 0, F.lit("No score available.")).when(f == 1, F.concat(F.lit("Result: "), obj)).otherwise(obj)
    return a.select("prompt_id", "model", "f", "score", raw.alias("raw_text"))


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7: 0..5 ranked hits per prompt, spread over all pages."""
    p = prompts(spark, sf_dir).select("prompt_id")
    pages = read_table(spark, sf_dir, "pages")
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    # sequence(1, 0) would count down, so prompts without hits are filtered first.
    hits = p.where(F.col("prompt_id") % 6 >= 1).select(
        "prompt_id", F.explode(F.sequence(F.lit(1), (F.col("prompt_id") % 6).cast("int"))).alias("rk")
    )
    hits = hits.withColumn("page_id", (F.col("prompt_id") * 13 + F.col("rk") * 7) % n_pages)
    # the title is cut out before the join, so no page text is moved
    titles = pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url")
    joined = hits.join(titles, "page_id")
    return joined.select(
        "prompt_id",
        "rk",
        "title",
        F.concat(F.lit("about page "), F.col("page_id").cast("string")).alias("snippet"),
        F.col("url").alias("link"),
    )


def realtime_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8: real-time classifier answers, including the 'untrue' substring trap."""
    p = prompts(spark, sf_dir).select("prompt_id")
    r = F.col("prompt_id") % 3
    return p.select(
        "prompt_id",
        F.when(r == 0, F.lit(" TRUE ")).when(r == 1, F.lit("False.")).otherwise(F.lit("That is untrue")).alias("raw_text"),
    )


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B9: documents in even 20-id blocks act as résumés."""
    d = _docs(spark, sf_dir)
    return d.where(F.floor(F.col("doc_id") / 20) % 2 == 0).select(
        F.col("doc_id").alias("resume_id"), "source", F.col("text").alias("resume")
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B9: documents in odd 20-id blocks act as job descriptions."""
    d = _docs(spark, sf_dir)
    return d.where(F.floor(F.col("doc_id") / 20) % 2 == 1).select(
        F.col("doc_id").alias("job_id"), "source", F.col("text").alias("jd")
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B9: each job is submitted with one résumé, the one 20 ids before it (all jobs have one).

    The pairing is an explicit key, as in the evaluation protocol (one résumé per
    request), so the match jobs are linear in the inputs, never all pairs of a source.
    """
    j = jobs(spark, sf_dir).select("job_id", "source", (F.col("job_id") - 20).alias("resume_id"))
    r = resumes(spark, sf_dir).select("resume_id")
    return j.join(r, "resume_id").select("job_id", "resume_id", "source")
