"""Batch model calls as one Arrow-batched operator (INF-1..6, STR-16).

A model call is an external request, so it cannot run JVM-side; it is the one
place that uses Python per row, through ``mapInPandas`` (Arrow batches):

* the client is created once per task from an injected, picklable factory;
* calls are retried a bounded number of times, then the role's error policy
  decides the output (sentinel text, null, False, fallback JSON);
* ``concurrency`` sets the number of simultaneous calls by repartitioning to that many tasks;
* the result must be materialised before it is used twice (``materialize``),
  so a re-planned stage never pays for a call again; with a ledger folder
  (``operators/ledger.py``) neither does a retried task or a rerun after a lost job.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import REALTIME_SYSTEM, REASONING_SYSTEM
from .ledger import TaskLedger, call_key, committed, key_of

# Per-role generation settings and error behaviour of the protocol.
ROLE_SETTINGS = {
    "answer": {"temperature": 0.3, "max_tokens": 1000, "on_error": "sentinel"},
    "answer_logger": {"temperature": 0.7, "max_tokens": 1000, "on_error": "null"},
    "judge": {"temperature": 0.3, "max_tokens": 1000, "on_error": "null"},
    "reasoning": {"temperature": 0.0, "max_tokens": 500, "on_error": "reasoning", "system": REASONING_SYSTEM},
    "realtime": {"temperature": 0.0, "max_tokens": None, "on_error": "false", "system": REALTIME_SYSTEM},
    "ats": {"temperature": 0.0, "max_tokens": None, "on_error": "ats_fallback"},
}
ATS_FALLBACK_JSON = '{"ats_score": 50, "strengths": [], "gaps": [], "suggestions": ["Check formatting."]}'


@dataclass(frozen=True)
class CallSpec:
    role: str
    temperature: float
    max_tokens: int | None
    system: str | None = None  # system message to send with the prompt


def error_output(role: str, model: str, exc: BaseException) -> str | None:
    """STR-16 and the per-role failure value."""
    policy = ROLE_SETTINGS[role]["on_error"]
    if policy == "sentinel":
        return f"[{model} Error] {exc}"
    if policy == "reasoning":
        return f"[Reasoning Error] {exc}"
    if policy == "false":
        return "False"
    if policy == "ats_fallback":
        return ATS_FALLBACK_JSON
    return None


def complete(
    df: DataFrame,
    client_factory: Callable[[], object],
    role: str,
    prompt_col: str = "request",
    model_col: str = "model",
    out_col: str = "raw_text",
    max_retries: int = 2,
    backoff_sec: float = 0.0,
    concurrency: int | None = None,
    threads_per_task: int = 1,
    ledger: str | None = None,
    commit_rows: int = 16,
) -> DataFrame:
    """Call ``client.complete(model, prompt, spec) -> str`` for every row.

    The rows are dealt to ``concurrency`` tasks, by default as many as the cluster has cores:
    a small prompt list in one partition would otherwise be called one by one.

    Adds ``out_col`` (text or null) and ``error`` (last error message or null).
    ``threads_per_task`` > 1 overlaps the (I/O-bound) calls of one Arrow batch
    on a thread pool; results keep the row order.

    With a ``ledger`` folder, finished calls are committed ``commit_rows`` at a time, and calls that it
    holds (of a retried task, or of an earlier run) are not made again.
    """
    if role not in ROLE_SETTINGS:
        raise ValueError(f"unknown role {role!r}")
    from ..session import ship_package

    ship_package(df.sparkSession)  # the task code below refers to this package
    s = ROLE_SETTINGS[role]
    spec = CallSpec(role, s["temperature"], s["max_tokens"], s.get("system"))
    schema = StructType(df.schema.fields + [StructField(out_col, StringType()), StructField("error", StringType())])
    shares = concurrency or df.sparkSession.sparkContext.defaultParallelism
    known = None
    if ledger is None:
        src = df.repartition(shares)
    else:
        keyed = df.withColumn("_call", call_key(role, F.col(model_col), F.col(prompt_col)))
        held = committed(df.sparkSession, ledger)
        if held is not None:
            known = keyed.join(held.withColumnRenamed("call_key", "_call"), "_call")
            known = known.select(*df.columns, F.col("text").alias(out_col), F.lit(None).cast("string").alias("error"))
            keyed = keyed.join(held.select(F.col("call_key").alias("_call")), "_call", "left_anti")
        # one name, one task: a request given twice is called for once
        src = keyed.repartition(shares, "_call").select(*df.columns)

    def call(client, model, prompt):
        err = None
        for attempt in range(max_retries + 1):
            try:
                return client.complete(model, prompt, spec), None
            except Exception as e:  # noqa: BLE001 - any client failure is data
                err = e
                if backoff_sec:
                    time.sleep(backoff_sec * (2 ** attempt))
        return error_output(role, model, err), str(err)

    def answers(client, pool, pairs):
        if pool is None:
            return [call(client, m, p) for m, p in pairs]
        return list(pool.map(lambda mp: call(client, *mp), pairs))

    def from_ledger(client, pool, pairs, done, share):
        """Answers of ``pairs``, those not yet in ``done`` called for and committed a few at a time."""
        keys = [key_of(role, m, p) for m, p in pairs]
        todo = list({k: mp for k, mp in zip(keys, pairs) if k not in done}.items())
        failed = {}
        for at in range(0, len(todo), commit_rows):
            some = todo[at : at + commit_rows]
            results = answers(client, pool, [mp for _, mp in some])
            finished = [(k, text) for (k, _), (text, err) in zip(some, results) if err is None]
            share.commit(finished)
            done.update(finished)
            failed.update({k: r for (k, _), r in zip(some, results) if r[1] is not None})
        return [(done[k], None) if k in done else failed[k] for k in keys]

    def run(batches):
        client = client_factory()
        pool = share = None
        done: dict = {}
        if ledger is not None:
            from pyspark import TaskContext

            share = TaskLedger(ledger, f"{role}-{TaskContext.get().partitionId()}-of-{shares}")
            done = share.read()
        if threads_per_task > 1:
            from concurrent.futures import ThreadPoolExecutor

            pool = ThreadPoolExecutor(max_workers=threads_per_task)
        try:
            for pdf in batches:
                pairs = list(zip(pdf[model_col].tolist(), pdf[prompt_col].tolist()))
                results = answers(client, pool, pairs) if share is None else from_ledger(client, pool, pairs, done, share)
                yield pdf.assign(**{out_col: [r[0] for r in results], "error": [r[1] for r in results]})
        finally:
            if pool is not None:
                pool.shutdown()

    out = src.mapInPandas(run, schema)
    return out if known is None else out.unionByName(known)


def materialize(df: DataFrame, name: str = "model_calls") -> DataFrame:
    """Persist paid call results before any reuse: written once under ``spark.checkpoint.dir``."""
    from ..session import materialize as write_once

    return write_once(df, name)
