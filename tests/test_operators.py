"""Unit tables per operator: pairing, ties, null keys, constant columns, box stats, retrieval."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echo_client import echo_client_factory

from panelscore.operators import analysis, charts, pairing, textmatch


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_robin_pairs(spark):
    panel = ["m1", "m2", "m3", "m4"]
    prompts = spark.range(5).withColumnRenamed("id", "prompt_id")
    t = pairing.fan_out(prompts, panel)
    pairs = pairing.judge_pairs(t, panel)
    rows = pairs.collect()
    assert len(rows) == 5 * 4 * 3
    assert all(r["target_model"] != r["evaluator"] for r in rows)
    # generated in place: no shuffle, no join
    plan = plan_text(pairs)
    assert "Exchange" not in plan and "Join" not in plan


def test_selection_before_calls(spark):
    panel = ["m1", "m2", "m3"]
    t = pairing.fan_out(spark.range(2).withColumnRenamed("id", "prompt_id"), panel, ["m3"])
    assert {r["model"] for r in t.collect()} == {"m3"}
    assert {r["model_idx"] for r in t.collect()} == {2}
    judged_all = pairing.judge_pairs(t, panel, ["m3"], panel="all")
    judged_sel = pairing.judge_pairs(t, panel, ["m3"], panel="selected")
    assert {r["evaluator"] for r in judged_all.collect()} == {"m1", "m2"}
    assert judged_sel.count() == 0
    with pytest.raises(ValueError):
        pairing.fan_out(spark.range(1).withColumnRenamed("id", "prompt_id"), panel, ["nope"])


def _evals(spark, rows):
    return spark.createDataFrame(
        rows, "target_model string, evaluator string, helpfulness double, correctness double, coherence double, clarity double"
    )


def test_ties_resolve_to_first_key(spark):
    df = _evals(spark, [("b", "x", 0.5, 0.5, 0.5, 0.5), ("a", "y", 0.5, 0.5, 0.5, 0.5), ("c", "x", 0.1, 0.1, 0.1, 0.1)])
    best = analysis.best_model(df).collect()[0]
    assert best["best_model"] == "a"
    strong = {r["metric"]: r["target_model"] for r in analysis.metric_extremes(df, True).collect()}
    weak = {r["metric"]: r["target_model"] for r in analysis.metric_extremes(df, False).collect()}
    assert strong == {"Helpfulness": "a", "Correctness": "a", "Coherence": "a", "Clarity": "a"}
    assert weak["Helpfulness"] == "c"
    ls = analysis.lenient_strict(df).collect()[0]
    assert (ls["most_lenient"], ls["most_strict"]) == ("y", "x")


def test_null_keys_per_grouping_set(spark):
    df = _evals(spark, [(None, "x", 1.0, 1.0, 1.0, 1.0), ("a", "x", 0.0, 0.0, 0.0, 0.0), ("a", None, 0.5, 0.5, 0.5, 0.5)])
    g = {(r["grouping"], r["target_model"], r["evaluator"]): r["helpfulness_mean"]
         for r in analysis.stats_grouping_sets(df).collect()}
    # the null-target row still counts for evaluator x
    assert g[("evaluator", None, "x")] == 0.5
    assert g[("target_model", "a", None)] == 0.25
    assert ("target_model", None, None) not in g
    assert set(k for k in g if k[0] == "target_model,evaluator") == {("target_model,evaluator", "a", "x")}


def test_std_of_single_value_is_null(spark):
    df = _evals(spark, [("a", "x", 0.5, 0.5, 0.5, 0.5)])
    r = analysis.model_stats(df).collect()[0]
    assert r["helpfulness_std"] is None and r["helpfulness_count"] == 1


def test_correlation_constant_and_pairwise(spark):
    rows = [(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 6.0), (4.0, 5.0, 8.0)]
    df = spark.createDataFrame(rows, "x double, k double, y double")
    r = {(a, b): v for a, b, v in charts.correlation_long(df).collect()}
    assert r[("x", "k")] is None and r[("k", "k")] is None
    assert r[("x", "x")] == 1.0
    x = np.array([1.0, 3.0, 4.0]); y = np.array([2.0, 6.0, 8.0])
    assert r[("x", "y")] == pytest.approx(round(np.corrcoef(x, y)[0, 1], 6))
    assert r[("y", "x")] == r[("x", "y")]


def test_box_stats_matches_numpy(spark):
    vals = [0.1, 0.2, 0.2, 0.3, 0.35, 0.4, 0.9, 0.05, None]
    df = spark.createDataFrame([("a", v) for v in vals], "target_model string, helpfulness double")
    r = charts.box_stats(df, "target_model", ["helpfulness"]).collect()[0]
    v = np.array([x for x in vals if x is not None])
    q1, med, q3 = np.percentile(v, [25, 50, 75])
    iqr = q3 - q1
    inside = v[(v >= q1 - 1.5 * iqr) & (v <= q3 + 1.5 * iqr)]
    assert r["n"] == len(v)
    assert r["q1"] == pytest.approx(q1) and r["median"] == pytest.approx(med) and r["q3"] == pytest.approx(q3)
    assert r["whisker_lo"] == pytest.approx(inside.min()) and r["whisker_hi"] == pytest.approx(inside.max())
    assert r["n_outliers"] == len(v) - len(inside)


def _brute_force(queries, docs, k=3):
    import math
    import re

    def toks(s):
        return {t for t in re.split("[^a-z0-9]+", s.lower()) if len(t) >= 3}

    dtok = {d: toks(t) for d, t in docs}
    df = {}
    for ts in dtok.values():
        for t in ts:
            df[t] = df.get(t, 0) + 1
    n = len(docs)
    out = set()
    for q, text in queries:
        qt = toks(text)
        scores = []
        for d, ts in dtok.items():
            shared = qt & ts
            if shared:
                scores.append((round(sum(math.log(n / df[t]) for t in shared), 6), d))
        scores.sort(key=lambda x: (-x[0], x[1]))
        for i, (s, d) in enumerate(scores[:k], 1):
            out.add((q, d, i, s))
    return out


@pytest.mark.parametrize("hot", [0.05, 0.3, 1.0])
def test_retrieval_exact_for_any_hot_threshold(spark, hot):
    docs = [(i, " ".join(w for j, w in enumerate(["alpha", "beta", "gamma", "delta", "omega", "the", "and", "of"])
                          if (i >> (j % 5)) & 1 or j >= 5)) for i in range(40)]
    queries = [(100 + i, t) for i, t in enumerate(["the alpha", "beta and gamma of", "omega delta", "nothing here",
                                                     "the and of", "alpha beta gamma delta omega"])]
    qd = spark.createDataFrame(queries, "prompt_id long, prompt string")
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r[0], r[1], r[2], r[3]) for r in textmatch.retrieve(qd, dd, k=3, hot_fraction=hot).collect()}
    assert got == _brute_force(queries, docs)


def test_display_view_first_model_and_last_prompt(spark):
    from panelscore.operators import responses

    rows = [
        ("r", 1, "m1", 0, "a1", "s1", False), ("r", 1, "m2", 1, "b1", "other", True),
        ("r", 2, "m1", 0, "a2", "", False), ("r", 2, "m2", 1, "b2", "x", True),
    ]
    df = spark.createDataFrame(rows, "run_id string, prompt_id long, model string, model_idx int, response string, "
                                     "search_results string, is_ats boolean").withColumn("card", F.lit(None).cast("string"))
    v = responses.display_view(df, ["m1", "m2"]).collect()[0]
    assert (v["m1"], v["m2"]) == ("a2", "b2")
    assert v["search_tab"] == "N/A" and v["is_ats"] is False


def test_evaluation_view_and_helpers(spark):
    from panelscore.config import METRICS
    from panelscore.functions import text

    ev = spark.createDataFrame([("m1", "m2", *[0.5] * 8)], "target_model string, evaluator string, " + ", ".join(f"{m} double" for m in METRICS))
    assert analysis.evaluation_view(ev).count() == 1
    off = analysis.evaluation_view(ev, enabled=False)
    assert off.count() == 0 and off.columns == ["target_model", "evaluator", *METRICS]
    r = spark.createDataFrame([("2024-03-05 07:08:09",)], "s string").select(
        text.run_id(F.to_timestamp("s")).alias("a"), text.run_id(F.to_timestamp("s"), F.lit(3)).alias("b"),
        text.ats_score_prompt(F.lit("resp"), F.lit("cv"), F.lit("jd")).alias("c"),
    ).collect()[0]
    assert r["a"] == "20240305_070809" and r["b"] == "20240305_070809_prompt_3"
    assert "Resume:\ncv\n\nJob Description:\njd\n\nResponse:\nresp" in r["c"]
    sorted_rows = analysis.display_sorted(spark.createDataFrame([("b",), (None,), ("a",)], "k string"), ["k"]).collect()
    assert [x[0] for x in sorted_rows] == ["a", "b", None]


def test_box_stats_of_continuous_scores(spark):
    """All values differ; many ranges hold one group; quartiles and whiskers as numpy finds them."""
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=5000), "b": rng.normal(size=7) * 10, "c": np.array([1.5]), "d": np.repeat([0.1, 0.2], 50)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "target_model string, helpfulness double").repartition(5)
    got = {r["target_model"]: r for r in charts.box_stats(df, "target_model", ["helpfulness"]).collect()}
    assert sorted(got) == sorted(groups)
    for g, vs in groups.items():
        q1, med, q3 = np.percentile(vs, [25, 50, 75])
        inside = vs[(vs >= q1 - 1.5 * (q3 - q1)) & (vs <= q3 + 1.5 * (q3 - q1))]
        expected = [len(vs), q1, med, q3, inside.min(), inside.max(), len(vs) - len(inside)]
        values = [got[g][c] for c in ("n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers")]
        assert np.allclose(values, expected, atol=2e-6), g


def test_correlation_scans_once(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.5, 1.0)], "a double, b double, c double")
    corr = charts.correlation_long(df)
    plan = corr._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1
    got = {(r["a"], r["b"]): r["r"] for r in corr.collect()}
    assert len(got) == 9 and got["a", "a"] == 1.0 and got["c", "c"] is None and got["a", "b"] == got["b", "a"] > 0.99


def test_empty_input_gives_empty_results(spark):
    empty = _evals(spark, []).withColumn("tone_score", F.lit(None).cast("double"))
    for fn in (analysis.model_stats, analysis.evaluator_stats, analysis.cross_eval, analysis.stats_grouping_sets,
               analysis.best_model, analysis.lenient_strict, analysis.overall_scores, analysis.report_long,
               lambda d: analysis.metric_extremes(d, True), lambda d: charts.box_stats(d, "target_model"),
               lambda d: charts.correlation_long(d), lambda d: charts.cross_pivot(d, ["x", "y"])):
        out = fn(empty)
        assert out.count() == 0, fn
        assert len(out.columns) > 0


def test_grouping_sets_single_scan(spark):
    from panelscore.plans import fixtures as fx

    df = analysis.stats_grouping_sets(fx.eval_facts(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
    assert "Expand" in plan


def test_selection_applied_before_model_calls(spark, tmp_path):
    from collections import Counter

    from panelscore.operators import inference

    log = str(tmp_path / "calls.log")
    prompts = spark.createDataFrame([(i, f"q{i}") for i in range(4)], "prompt_id long, prompt string")
    targets = pairing.fan_out(prompts, ["m1", "m2", "m3"], ["m2"]).withColumn("request", F.col("prompt"))
    out = inference.complete(targets, echo_client_factory(log_path=log), "answer")
    assert out.count() == 4
    assert Counter(line.split("\t")[1] for line in open(log)) == {"m2": 4}


def test_report_lines_and_usable_filter(spark, tmp_path):
    from panelscore.operators import scoring
    from panelscore.sources import sinks

    df = _evals(spark, [("a", "x", 0.5, 0.25, 0.5, 0.5), ("b", "y", 0.1, 0.2, 0.3, 0.4)])
    text = analysis.report_text(analysis.report_long(df), df.columns, "evals.csv", "2024-01-01 00:00:00")
    lines = [r["value"] for r in text.orderBy("line_no").collect()]
    assert lines[:6] == ["LLM EVALUATION ANALYSIS REPORT", "=" * 50, "Generated: 2024-01-01 00:00:00", "Data source: evals.csv", "Total records: 2", ""]
    assert lines[6:9] == ["DATASET OVERVIEW", "-" * 20, f"Shape: (2, {len(df.columns)})"] and lines[9] == f"Columns: {df.columns}"
    assert "a 0.500 NaN 1 0.250 NaN 0.500 NaN 0.500 NaN" in lines and "Best performing model (overall): a" in lines and "Average score: 0.438" in lines
    at = lines.index("Model Strengths:")
    assert lines[at + 1 : at + 8] == ["  Helpfulness: a (0.500)", "  Correctness: a (0.250)", "  Coherence: a (0.500)", "  Clarity: a (0.500)", "", "Model Weaknesses:", "  Helpfulness: b (0.100)"]
    assert lines[-2:] == ["=" * 50, "Report generation completed."]
    path = sinks.write_report_text(text, str(tmp_path / "report"))
    files = [f for f in (tmp_path / "report").iterdir() if f.name.startswith("part-")]
    assert path and len(files) == 1 and files[0].read_text(encoding="utf-8").splitlines() == lines
    simple = spark.createDataFrame([("m", 0.5)], "model string, helpfulness double")
    lines = [r["value"] for r in analysis.report_text(analysis.report_long(simple), simple.columns, "s.csv", "now").orderBy("line_no").collect()]
    assert "Total records: 1" in lines and "KEY INSIGHTS" in lines and "Model Strengths:" not in lines and "MODEL PERFORMANCE SUMMARY" not in lines
    raw = spark.createDataFrame([(1, "m1", "m2", '{"helpfulness": 1}'), (1, "m2", "m1", "nope")],
                                "prompt_id long, target_model string, evaluator string, raw_text string")
    usable = scoring.usable_judgments(scoring.parsed_judgments(raw))
    assert [r["target_model"] for r in usable.collect()] == ["m1"]


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_score = st.one_of(st.none(), st.integers(0, 100).map(lambda x: x / 100))
_row = st.tuples(st.sampled_from(["a", "b", "c", None]), st.sampled_from(["x", "y"]), _score, _score, _score, _score)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_row, min_size=1, max_size=40))
def test_stats_against_pandas(spark, rows):
    import pandas as pd

    cols = ["target_model", "evaluator", "helpfulness", "correctness", "coherence", "clarity"]
    pdf = pd.DataFrame(rows, columns=cols)
    df = _evals(spark, rows)
    # AGG-1 + AGG-7
    got = {r["target_model"]: r for r in analysis.model_stats(df).collect()}
    exp = pdf.groupby("target_model").agg({"helpfulness": ["mean", "std", "count"], "clarity": ["mean"]})
    assert set(got) == set(exp.index)
    for k in exp.index:
        for name, col in (("helpfulness_mean", ("helpfulness", "mean")), ("helpfulness_std", ("helpfulness", "std")),
                          ("clarity_mean", ("clarity", "mean"))):
            e = exp.loc[k, col]
            g = got[k][name]
            assert (g is None and pd.isna(e)) or (g is not None and abs(g - round(float(e), 3)) <= 0.0015), (k, name, g, e)
        assert got[k]["helpfulness_count"] == exp.loc[k, ("helpfulness", "count")]
    # AGG-8: macro average of the four metric means, nulls skipped
    means = pdf.groupby("target_model")[cols[2:]].mean().mean(axis=1)
    o = {r["name"]: r["overall"] for r in analysis.overall_scores(df).collect() if r["kind"] == "target_model"}
    for k, v in means.items():
        assert (o[k] is None and pd.isna(v)) or abs(o[k] - v) < 1e-6
    # AGG-13 pivot vs pandas pivot_table (all-null rows dropped)
    piv = {r["target_model"]: r for r in charts.cross_pivot(df, ["x", "y"]).collect()}
    pt = pdf.pivot_table(values="helpfulness", index="target_model", columns="evaluator", aggfunc="mean")
    assert set(piv) == set(pt.dropna(how="all").index)


def test_unpivot_pivot_round_trip(spark):
    from panelscore.config import METRICS
    from panelscore.plans import fixtures as fx

    facts = fx.eval_facts(spark, "/root/testdata/sf0.001")
    wide = {r["target_model"]: r.asDict() for r in charts.heatmap(facts).collect()}
    long = charts.bar_long(facts)
    back = long.groupBy("target_model").pivot("variable", METRICS).agg(F.first("value"))
    for r in back.collect():
        assert {m: r[m] for m in METRICS} == {m: wide[r["target_model"]][m] for m in METRICS}
    assert long.count() == len(wide) * len(METRICS)


def test_averages_keep_runs_apart(spark):
    from panelscore.config import METRICS
    from panelscore.operators import scoring

    nums = ", ".join(f"num_{m} double" for m in METRICS)
    rows = [(run, 1, "m", e, "ok", *[v] * len(METRICS)) for run, v in (("r1", 0.2), ("r2", 0.8)) for e in ("a", "b")]
    df = spark.createDataFrame(rows, f"run_id string, prompt_id long, target_model string, evaluator string, status string, {nums}")
    assert {(r["run_id"], r["avg_clarity"]) for r in scoring.target_averages(df).collect()} == {("r1", 0.2), ("r2", 0.8)}


def test_broadcast_is_checked_by_rows_and_bytes(spark):
    from panelscore.operators.joins import bounded_broadcast

    df = spark.createDataFrame([("x" * 1000, 1), (None, 2)], "token string, n int")
    hint = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hint(bounded_broadcast(df, 2)) and not hint(bounded_broadcast(df, 1)) and not hint(bounded_broadcast(df, 2, max_bytes=999))
    assert hint(bounded_broadcast(df.select("n"), 2, max_bytes=0)) and hint(bounded_broadcast(df.limit(0), 2))


def test_retrieval_writes_no_candidates(spark, monkeypatch):
    """No pairs of queries and documents are written, whatever tokens they share; blocks of any size agree."""
    docs = [(i, " ".join(f"word{(i * 7 + j) % 23}" for j in range(1 + i % 9))) for i in range(120)] + [(5, "word3 word4")]
    queries = [(1000 + i, " ".join(f"word{(i * 5 + j) % 29}" for j in range(4))) for i in range(40)]
    qd, dd = spark.createDataFrame(queries, "prompt_id long, prompt string"), spark.createDataFrame(docs, "doc_id long, text string")
    written, keep = [], textmatch.checkpointed
    monkeypatch.setattr(textmatch, "checkpointed", lambda df, name="stage": written.append(df.columns) or keep(df, name))
    got = [sorted(textmatch.retrieve(qd, dd, block_postings=n).collect()) for n in (10, 1_000_000)]
    assert got[0] == got[1] and len(got[0]) >= 100
    assert not [c for c in written if "prompt_id" in c and "doc_id" in c]


def test_exact_round_is_bround(spark):

    x = [0.0000005, 0.0000015, 1.0000025, 2.3456785, 7.1234565, 3.0000005000001, 12.5, 1e-9]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.bround("x", 6)).collect()]
    assert textmatch.exact_round(np.array(x), 6).tolist() == want


def test_semantic_match_shuffles_texts_not_tokens(spark):
    """Ids that stand twice count as one document, applications that stand twice count twice; tokens stay where their texts are."""
    r = spark.createDataFrame([(1, "spark sql joins"), (1, "window sql"), (2, "rust"), (None, "lost text")], "resume_id long, resume string")
    j = spark.createDataFrame([(7, "sql joins spark"), (8, ""), (9, "rust sql")], "job_id long, jd string")
    a = spark.createDataFrame([(7, 1), (7, 1), (8, 2), (9, 2), (9, None), (9, 5)], "job_id long, resume_id long")
    out = textmatch.semantic_match(a, r, j)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "token" in line]

    ln, n = np.log, 7
    idf = {"spark": ln(n / 2), "sql": ln(n / 3), "joins": ln(n / 2), "window": ln(n), "rust": ln(n / 2)}
    texts = {"r1": "spark sql joins window sql", "r2": "rust", "j7": "sql joins spark", "j9": "rust sql"}
    w = {d: {t: s.split().count(t) * idf[t] for t in set(s.split())} for d, s in texts.items()}
    norm = {d: np.sqrt(sum(x * x for x in v.values())) for d, v in w.items()}
    cos = lambda x, y: sum(w[x][t] * w[y].get(t, 0) for t in w[x]) / (norm[x] * norm[y])
    got = sorted(((x[0], x[1] or 0, x[2]) for x in out.collect()), key=str)
    want = [(7, 1, round(2 * cos("j7", "r1"), 6))] * 2 + [(8, 2, None), (9, 0, None), (9, 2, round(cos("j9", "r2"), 6)), (9, 5, None)]
    assert got == sorted(want, key=str)


def test_judgments_are_dealt_before_they_fan_out(spark):
    """Prompts weigh a few bytes: without a fixed number of partitions their judgments stand in a few tasks."""
    from data_dirs import SF_SMALL
    from panelscore.plans import fixtures as fx

    cores = spark.sparkContext.defaultParallelism
    assert fx.judgments_raw(spark, SF_SMALL).rdd.getNumPartitions() >= 4 * cores


@pytest.mark.parametrize("twice", [False, True])
def test_a_block_scores_few_documents_whole(monkeypatch, twice):
    """The best documents are those of brute force, ties and documents that stand twice included; common tokens are looked up for few documents."""
    import pyarrow as pa

    rng, n, words = np.random.default_rng(5), 4000, 3000
    share = np.minimum(0.9, 8 / np.arange(1, words + 1))
    has = rng.random((n, words)) < share
    ids = rng.permutation(n) + 100
    lists, rows = [np.flatnonzero(x).astype(np.int32) for x in has], np.arange(n)
    if twice:
        rows = np.append(rows, rng.choice(n, 300))
    queries = [np.unique(rng.choice(words, 14, p=share / share.sum())).astype(np.int32) for _ in range(80)]
    queries += [np.array([0, 1], np.int32), np.array([words + 5], np.int32), np.array([0, words - 1], np.int32)]
    idf = np.append(np.log(n / np.maximum(1, has.sum(0))), np.zeros(10))
    idf[0] = 0.0  # such a token adds nothing, but what has it is found
    looked_up, keep = [], textmatch.Postings._looked_up
    monkeypatch.setattr(textmatch.Postings, "_looked_up", lambda self, rows, idfs, docs: looked_up.append(len(rows) * len(docs)) or keep(self, rows, idfs, docs))
    block = textmatch.Block(pa.array(ids[rows]), pa.array([lists[i] for i in rows], pa.list_(pa.int32())), textmatch.COMMON)
    query, places, scores = block.best(np.concatenate(queries), idf[np.concatenate(queries)], np.cumsum([len(q) for q in queries]), 3, 6)
    times = np.bincount(rows, minlength=n)
    want = []
    for i, q in enumerate(queries):
        q = q[q < words]
        whole = has[:, q] @ idf[q] * times
        shared = np.flatnonzero(has[:, q].any(1))
        want += [(i, int(ids[d]), round(float(whole[d]), 6)) for d in sorted(shared, key=lambda d: (-round(float(whole[d]), 6), ids[d]))[:3]]
    got = list(zip(query.tolist(), block.ids.take(pa.array(places)).to_pylist(), scores.tolist()))
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])
    assert sum(looked_up) < 0.1 * n * sum(len(q) for q in queries)


def test_blocks_have_a_partition_each(spark):
    from panelscore.operators.joins import partition_keys

    keys = partition_keys(spark, 24)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(24, "k").select(F.spark_partition_id().alias("p"))
    assert len(keys) == 24 == df.distinct().count()
