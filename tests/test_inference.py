"""Model calls: each (prompt, model, role) called once end to end; per-role error policies."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from echo_client import echo_client_factory

from panelscore.config import METRICS
from panelscore.operators import inference
from panelscore.plans.catalog import evaluate_panel

PANEL = ["m1", "m2", "m3"]


def test_each_call_happens_once(spark, tmp_path):
    log = str(tmp_path / "calls.log")
    prompts = spark.createDataFrame([(i, f"question number {i}") for i in range(7)], "prompt_id long, prompt string")
    rows = evaluate_panel(prompts, PANEL, echo_client_factory(log_path=log))
    out = rows.collect()
    rows.count()  # a second action must not call the models again
    assert len(out) == 7 * 3 * 2
    calls = Counter(line.split("\t")[0] for line in open(log))
    assert calls == {"answer": 7 * 3, "judge": 7 * 3 * 2}
    keys = Counter(tuple(line.split("\t")) for line in open(log))
    assert max(keys.values()) == 1
    # scores follow the offline judge rule
    r = out[0]
    assert all(0.0 <= r[m] <= 1.0 for m in METRICS)


def test_error_policies(spark):
    df = spark.createDataFrame([("m1", "p"), ("bad", "p")], "model string, request string")
    f = echo_client_factory(fail_models=["bad"])
    ans = {r["model"]: (r["raw_text"], r["error"]) for r in inference.complete(df, f, "answer", max_retries=1).collect()}
    assert ans["m1"] == ("M1: p", None)
    assert ans["bad"][0] == "[bad Error] service unavailable" and ans["bad"][1] == "service unavailable"
    judge = {r["model"]: r["raw_text"] for r in inference.complete(df, f, "judge").collect()}
    assert judge["bad"] is None
    rt = {r["model"]: r["raw_text"] for r in inference.complete(df, f, "realtime").collect()}
    assert rt["bad"] == "False"
    ats = {r["model"]: r["raw_text"] for r in inference.complete(df, f, "ats").collect()}
    assert '"ats_score": 50' in ats["bad"]
    rs = {r["model"]: r["raw_text"] for r in inference.complete(df, f, "reasoning").collect()}
    assert rs["bad"].startswith("[Reasoning Error] ")


def test_system_messages_are_handed_to_the_client(spark):
    class ShowSystem:
        def complete(self, model, prompt, spec):
            return f"{spec.system}|{spec.temperature}"

    df = spark.createDataFrame([("m1", "p")], "model string, request string")
    got = {role: inference.complete(df, ShowSystem, role).first()["raw_text"] for role in ("realtime", "reasoning", "judge")}
    # fixed texts of the protocol
    assert got["realtime"] == (
        "Respond only with 'True' or 'False'. Does the following prompt require real-time or "
        "up-to-date information to answer accurately?|0.0"
    )
    assert got["reasoning"] == "You're an AI that explains why a given answer was provided.|0.0"
    assert got["judge"] == "None|0.3"


def test_concurrency_cap_repartitions(spark):
    df = spark.range(20).select(F.lit("m1").alias("model"), F.col("id").cast("string").alias("request"))
    out = inference.complete(df, echo_client_factory(), "answer", concurrency=3)
    assert out.rdd.getNumPartitions() == 3
    assert out.count() == 20


def _hits(spark):
    return spark.createDataFrame([], "prompt_id long, rk int, title string, snippet string, link string")


def test_calls_per_prompt_full_flow(spark, tmp_path):
    """13 calls per prompt with three models (1 classifier + 3 answers + 3 explanations + 6 judgments)."""
    from panelscore.plans.catalog import run_evaluation

    log = str(tmp_path / "calls.log")
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(5)], "prompt_id long, prompt string")
    rows = run_evaluation(prompts, PANEL, echo_client_factory(log_path=log), _hits(spark))
    assert rows.count() == 5 * 6
    calls = Counter(line.split("\t")[0] for line in open(log))
    assert calls == {"realtime": 5, "answer": 15, "reasoning": 15, "judge": 30}
    assert sum(calls.values()) == 13 * 5


def test_selection_saves_calls(spark, tmp_path):
    """One selected model: 1 + 1 + 1 + 2 calls per prompt (selection happens before any call)."""
    from panelscore.plans.catalog import run_evaluation

    log = str(tmp_path / "calls.log")
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(4)], "prompt_id long, prompt string")
    rows = run_evaluation(prompts, PANEL, echo_client_factory(log_path=log), _hits(spark), selected=["m2"])
    assert {r["target_model"] for r in rows.collect()} == {"m2"}
    calls = Counter(line.split("\t")[0] for line in open(log))
    assert calls == {"realtime": 4, "answer": 4, "reasoning": 4, "judge": 8}


def test_threaded_calls_keep_order(spark):
    df = spark.range(50).select(F.lit("m1").alias("model"), F.col("id").cast("string").alias("request"))
    out = inference.complete(df, echo_client_factory(), "answer", threads_per_task=8)
    assert all(r["raw_text"] == f"M1: {r['request']}" for r in out.collect())


def test_command_line_flow_drops_failed_answers(spark, tmp_path):
    log = str(tmp_path / "calls.log")
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(3)], "prompt_id long, prompt string")
    rows = evaluate_panel(prompts, PANEL, echo_client_factory(fail_models=["m1"], log_path=log),
                          answer_role="answer_logger", drop_failed=True).collect()
    # m1 never answers (not a target) and its judgments fail (dropped): one judge left per target
    assert sorted({(r["target_model"], r["evaluator"]) for r in rows}) == [("m2", "m3"), ("m3", "m2")]
    calls = Counter(line.split("\t")[0] for line in open(log))
    # every failing call is attempted 1 + max_retries (= 3) times
    assert calls == {"answer_logger": 3 * (2 + 3), "judge": 3 * 2 * (1 + 3)}


def test_error_sentinels_keep_or_drop(spark):
    prompts = spark.createDataFrame([(1, "p")], "prompt_id long, prompt string")
    f = echo_client_factory(fail_models=["m1"])
    kept = evaluate_panel(prompts, PANEL, f, errors="keep").collect()
    # m1's answer is the sentinel text and is judged by m2 and m3 (m1's own judgments fail)
    assert any(r["target_model"] == "m1" and r["response"].startswith("[m1 Error]") for r in kept)
    dropped = evaluate_panel(prompts, PANEL, f, errors="drop").collect()
    assert {r["target_model"] for r in dropped} == {"m2", "m3"}


def _dying_factory(log, die_after):
    """A client whose worker process is killed at its call number ``die_after``, before the call is made."""

    def make():
        client = echo_client_factory(log_path=log)()
        made = []

        class Dying:
            def complete(self, model, prompt, spec):
                import os
                import signal

                if len(made) >= die_after:
                    os.kill(os.getpid(), signal.SIGKILL)
                made.append(1)
                return client.complete(model, prompt, spec)

        return Dying()

    return make


def test_ledger_pays_once_after_a_killed_task(spark, tmp_path):
    log, ledger = str(tmp_path / "calls.log"), str(tmp_path / "ledger")
    df = spark.range(40).select(F.lit("m1").alias("model"), F.concat(F.lit("q"), (F.col("id") % 36).cast("string")).alias("request"), "id")
    calls = {"ledger": ledger, "commit_rows": 1, "concurrency": 4}
    with pytest.raises(Exception):
        inference.complete(df, _dying_factory(log, 5), "answer", **calls).collect()
    before = len(open(log).readlines())
    assert 0 < before < 36
    rows = inference.complete(df, echo_client_factory(log_path=log), "answer", **calls)
    for _ in range(2):  # a second action makes no call either
        assert sorted((r["id"], r["raw_text"], r["error"]) for r in rows.collect()) == sorted((i, f"M1: q{i % 36}", None) for i in range(40))
    # another number of tasks, another job
    assert inference.complete(df, echo_client_factory(log_path=log), "answer", ledger=ledger, concurrency=3).count() == 40
    counts = Counter(open(log).readlines())
    assert len(counts) == 36 and max(counts.values()) == 1


def test_retried_task_reads_its_share(tmp_path):
    from panelscore.operators import ledger

    share = ledger.TaskLedger(str(tmp_path), "answer-0-of-2")
    assert share.read() == {}
    share.commit([("k1", "a"), ("k2", None)])
    share.commit([])
    (tmp_path / "share=answer-0-of-2" / "_half").write_bytes(b"broken off")
    assert ledger.TaskLedger(f"file:{tmp_path}", "answer-0-of-2").read() == {"k1": "a", "k2": None}
    assert ledger.TaskLedger(str(tmp_path), "answer-1-of-2").read() == {}


def test_ledger_names_and_failures(spark, tmp_path):
    from panelscore.operators import ledger

    rows = [("m1", "p"), ("m1", None), (None, "é"), ("bad", "p")]
    df = spark.createDataFrame(rows, "model string, request string")
    keys = [r[0] for r in df.select(ledger.call_key("judge", F.col("model"), F.col("request"))).collect()]
    assert keys == [ledger.key_of("judge", m, p) for m, p in rows]
    log, folder = str(tmp_path / "calls.log"), str(tmp_path / "ledger")
    bad = spark.createDataFrame([("m1", "p"), ("bad", "p")], "model string, request string")
    for _ in range(2):
        got = inference.complete(bad, echo_client_factory(fail_models=["bad"], log_path=log), "answer", max_retries=0, ledger=folder, threads_per_task=2)
        assert {r["model"]: r["raw_text"] for r in got.collect()} == {"m1": "M1: p", "bad": "[bad Error] service unavailable"}
    # the failure was tried again, the finished call was not
    assert Counter(line.split("\t")[1] for line in open(log)) == {"m1": 1, "bad": 2}


def test_full_flow_with_a_ledger_is_free_the_second_time(spark, tmp_path):
    from panelscore.plans.catalog import run_evaluation

    log, folder = str(tmp_path / "calls.log"), str(tmp_path / "ledger")
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(3)], "prompt_id long, prompt string")
    first = run_evaluation(prompts, PANEL, echo_client_factory(log_path=log), _hits(spark), ledger=folder).collect()
    made = len(open(log).readlines())
    second = run_evaluation(prompts, PANEL, echo_client_factory(log_path=log), _hits(spark), ledger=folder).collect()
    assert sorted(map(str, first)) == sorted(map(str, second)) and made == len(open(log).readlines()) == 13 * 3
