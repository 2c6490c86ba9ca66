"""Command line flows: evaluate a prompt file, then analyze the newest results."""

import os

from panelscore import cli
from panelscore.sources import files, sinks


def test_evaluate_then_analyze(spark, tmp_path):
    prompts = tmp_path / "prompts.txt"
    prompts.write_text("What is Spark?\n\n  Explain shuffles \nWhy parquet?\n", encoding="utf-8")
    results = str(tmp_path / "results")
    out = cli.run_evaluate(spark, str(prompts), results, ["m1", "m2", "m3"], run_ts="20240101_000000",
                           client="echo_client:echo_client_factory")
    assert out and os.path.isdir(out)
    rows = files.read_eval_csv(spark, out).collect()
    assert len(rows) == 3 * 3 * 2
    assert {r["prompt"] for r in rows} == {"What is Spark?", "Explain shuffles", "Why parquet?"}
    written = cli.run_analyze(spark, results, str(tmp_path / "analysis"))
    assert set(written) >= {"model_stats", "evaluator_stats", "cross_eval", "correlation", "report"}
    stats = spark.read.options(header="true").csv(written["model_stats"]).collect()
    assert [r["target_model"] for r in stats] == ["m1", "m2", "m3"]
    report = [r[0] for r in spark.read.text(written["report"]).collect()]
    assert report[0] == "LLM EVALUATION ANALYSIS REPORT" and report[4] == "Total records: 18"
    assert report[3].startswith("Data source: ") and "comprehensive_eval_" in report[3]


def test_full_run_searches_and_explains(spark, tmp_path):
    prompts = tmp_path / "prompts.txt"
    prompts.write_text("even\nodd\n", encoding="utf-8")  # the offline classifier says real-time for even lengths
    hits = tmp_path / "hits.jsonl"
    hits.write_text('{"prompt": "even", "items": [{"title": "T", "snippet": "S", "link": "L"}]}\n'
                    '{"prompt": "odd", "items": [{"title": "X"}]}\n')
    results = str(tmp_path / "results")
    out = cli.run_full(spark, str(prompts), results, ["m1", "m2", "m3"], run_ts="20240103_000000",
                       client="echo_client:echo_client_factory", hits_path=str(hits), concurrency=2)
    assert out == f"{results}/batch_20240103_000000/evaluation.csv"
    rows = sinks.read_bundle(spark, f"{results}/bundle", "evaluation").collect()
    assert len(rows) == 2 * 3 * 2
    for r in rows:
        assert r["explainability"] == f"because {r['target_model']}"
        assert ("**T**\nS\n L" in r["response"]) == (r["prompt"] == "even") and "X" not in r["response"]
    for name in ("heatmap", "radar", "bar"):
        assert sinks.read_bundle(spark, f"{results}/bundle", name).count() > 0


def test_analyze_simple_layout(spark, tmp_path):
    f = tmp_path / "simple.csv"
    f.write_text("model,helpfulness,correctness,coherence,clarity\na,0.5,0.5,0.5,0.5\na,0.7,0.1,NA,0.2\nb,1,1,1,1\n")
    written = cli.run_analyze(spark, None, str(tmp_path / "out"), csv_file=str(f))
    stats = {r["model"]: r for r in spark.read.options(header="true").csv(written["model_stats"]).collect()}
    assert float(stats["a"]["helpfulness_mean"]) == 0.6 and stats["a"]["coherence_std"] is None


def test_single_prompt_summary(spark, tmp_path):
    results = str(tmp_path / "results")
    out = cli.run_evaluate(spark, None, results, ["m1", "m2", "m3"], run_ts="20240102_000000",
                           prompt="  How do joins shuffle?  ", client="echo_client:echo_client_factory", concurrency=2)
    assert out
    summary = {r["target_model"]: r for r in spark.read.options(header="true").csv(f"{results}/summary_20240102_000000").collect()}
    assert set(summary) == {"m1", "m2", "m3"}
    assert summary["m1"]["evaluators"] == "m2, m3"
