"""Command line: ``python -m panelscore evaluate|run|analyze``.

evaluate  prompts (CSV with a ``prompt`` column, or text, one per line) -> panel
          answers -> round-robin judgments -> evaluation CSV + parquet of one run
run       the same with the real-time check, search context and explanations ->
          batch evaluation CSV + bundle (evaluation and chart tables) of one run
analyze   newest (or given) evaluation CSV -> statistics, chart tables and the
          report (tables as CSV folders, report as text)
"""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import sys

from pyspark.sql import functions as F

from .config import DEFAULT_PANEL
from .operators import analysis, charts, inference, search
from .session import apply_query_conf, build_session
from .sources import files, sinks


def _factory(spec: str | None):
    """``module:callable`` returning a client factory."""
    if not spec:
        raise ValueError("name a model client: --client module:callable")
    mod, _, name = spec.partition(":")
    return getattr(importlib.import_module(mod), name)()


def _prompts(spark, prompts_path: str | None, prompt: str | None):
    """(prompt_id, prompt) of a prompt CSV or text file, or of one prompt."""
    if prompt is not None:
        p = spark.createDataFrame([(1, prompt.strip())], "prompt_id long, prompt string").where(F.length("prompt") > 0)
    elif prompts_path.endswith(".csv"):
        p = files.read_prompts_csv(spark, prompts_path)
        p = files.number_rows(p, "prompt_id")
    else:
        p = files.read_prompts_text(spark, prompts_path).withColumnRenamed("line_no", "prompt_id")
    return p.select(F.col("prompt_id").cast("long").alias("prompt_id"), "prompt")


def _search_hits(spark, prompts, path: str | None):
    """Ranked hits of the prompts: JSON lines with ``prompt`` and ``items`` (title, snippet, link each).

    Of several lines for one prompt the first by its text counts; without a file nothing is found.
    """
    if path is None:
        return spark.createDataFrame([], "prompt_id long, rk int, title string, snippet string, link string")
    found = spark.read.schema("prompt string, items string").json(path)
    found = found.groupBy("prompt").agg(F.min("items").alias("items_json"))
    return search.hits_from_json(prompts.join(found, "prompt").select("prompt_id", "items_json"))


def run_full(spark, prompts_path: str | None, out_dir: str, models, selected=None, client=None,
             run_ts: str | None = None, prompt: str | None = None, hits_path: str | None = None,
             concurrency: int | None = None, threads_per_task: int = 1, ledger: str | None = None) -> str | None:
    """Real-time check, search context, answers, explanations and judgments; batch CSV and bundle."""
    from .plans.catalog import run_evaluation

    apply_query_conf(spark)
    p = inference.materialize(_prompts(spark, prompts_path, prompt), "prompts")
    rows = run_evaluation(p, models, _factory(client), _search_hits(spark, p, hits_path), selected,
                          concurrency=concurrency, threads_per_task=threads_per_task, ledger=ledger)
    rows = inference.materialize(rows, "evaluations")
    run_ts = run_ts or dt.datetime.now().strftime("%Y%m%d_%H%M%S")
    out = sinks.write_batch_evaluation(rows, out_dir, run_ts)
    if out:
        tables = {"evaluation": rows, "heatmap": charts.heatmap(rows), "radar": charts.radar(rows), "bar": charts.bar_long(rows)}
        sinks.write_bundle(tables, f"{out_dir.rstrip('/')}/bundle", run_ts)
    return out


def run_evaluate(spark, prompts_path: str | None, out_dir: str, models, selected=None, client=None,
                 run_ts: str | None = None, prompt: str | None = None, concurrency: int | None = None,
                 threads_per_task: int = 1, ledger: str | None = None) -> str | None:
    from .operators.scoring import summary_from_rows
    from .plans.catalog import evaluate_panel

    apply_query_conf(spark)
    p = _prompts(spark, prompts_path, prompt)
    rows = evaluate_panel(p, models, _factory(client), selected, answer_role="answer_logger", drop_failed=True,
                          concurrency=concurrency, threads_per_task=threads_per_task, ledger=ledger)
    rows = inference.materialize(rows, "evaluations")  # read by the CSV, the parquet table and the summary
    run_ts = run_ts or dt.datetime.now().strftime("%Y%m%d_%H%M%S")
    out = sinks.write_comprehensive(rows, out_dir, run_ts)
    if out:
        sinks.write_run_partition(rows.withColumn("run_id", F.lit(run_ts)), f"{out_dir}/parquet")
        summary = summary_from_rows(spark.read.parquet(f"{out_dir}/parquet/run_id={run_ts}"))
        summary.write.mode("overwrite").options(header="true").csv(f"{out_dir}/summary_{run_ts}")
    return out


def run_analyze(spark, results_dir: str | None, out_dir: str, csv_file: str | None = None) -> dict:
    apply_query_conf(spark)
    df = files.read_eval_any(spark, csv_file) if csv_file else files.latest_eval_csv(spark, results_dir)
    df = df.drop("file_path", "file_mtime")
    fmt = analysis.eval_format(df)
    tables = {}
    if fmt == "comprehensive":
        tables.update(
            model_stats=analysis.display_sorted(analysis.model_stats(df), ["target_model"]),
            evaluator_stats=analysis.display_sorted(analysis.evaluator_stats(df), ["evaluator"]),
            cross_eval=analysis.display_sorted(analysis.cross_eval(df), ["target_model", "evaluator"]),
            box_by_model=charts.box_stats(df, "target_model"),
            box_by_evaluator=charts.box_stats(df, "evaluator"),
            correlation=charts.correlation_long(df),
            cross_pivot=charts.cross_pivot(df),
            heatmap=charts.heatmap(df),
            radar=charts.radar(df),
            bar=charts.bar_long(df),
        )
    elif fmt == "simple":
        tables["model_stats"] = analysis.display_sorted(analysis.simple_stats(df), ["model"])
    written = {}
    for name, t in tables.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        t.write.mode("overwrite").options(header="true").csv(path)
        written[name] = path
    source = csv_file or files.newest_csv(spark, results_dir) or results_dir
    report = analysis.report_text(analysis.report_long(df), df.columns, source, dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S"))
    written["report"] = sinks.write_report_text(report, f"{out_dir.rstrip('/')}/report")
    return written


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="panelscore")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ev = sub.add_parser("evaluate", help="answer and judge a prompt file with the model panel")
    full = sub.add_parser("run", help="evaluate with real-time check, search context and explanations")
    full.add_argument("--hits", default=None, help="search hits: JSON lines with prompt and items")
    for cmd in (ev, full):
        cmd.add_argument("prompts", nargs="?", default=None, help="prompt CSV or text file")
        cmd.add_argument("--prompt", default=None, help="a single prompt instead of a file")
        cmd.add_argument("--out", default="results")
        cmd.add_argument("--models", default=",".join(DEFAULT_PANEL))
        cmd.add_argument("--select", default="")
        cmd.add_argument("--client", required=True, help="module:callable returning a client factory")
        cmd.add_argument("--concurrency", type=int, default=None, help="tasks that call models at a time (default: the cluster's cores)")
        cmd.add_argument("--ledger", default=None, help="shared folder of finished calls: a rerun pays for none of them again")
        cmd.add_argument("--threads-per-task", type=int, default=1, help="calls that a task overlaps")
    an = sub.add_parser("analyze", help="statistics, chart tables and report of evaluation results")
    an.add_argument("--results", default="results")
    an.add_argument("--file", default=None)
    an.add_argument("--out", default="analysis_results")
    args = ap.parse_args(argv)
    spark = build_session()
    if args.cmd in ("evaluate", "run"):
        sel = [m for m in args.select.split(",") if m]
        if not args.prompts and args.prompt is None:
            ap.error("give a prompt file or --prompt")
        flow, more = (run_full, {"hits_path": args.hits}) if args.cmd == "run" else (run_evaluate, {})
        out = flow(spark, args.prompts, args.out, args.models.split(","), sel or None, args.client,
                   prompt=args.prompt, concurrency=args.concurrency, threads_per_task=args.threads_per_task, ledger=args.ledger, **more)
        print(out or "no results")
    else:
        for name, path in run_analyze(spark, args.results, args.out, args.file).items():
            print(f"{name}: {path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
