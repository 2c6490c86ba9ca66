"""Sinks: evaluation CSV layouts, batch output, run bundle, report text (SNK-1..5).

Parquet is the primary store; CSV files keep the exchange layouts (header,
RFC-4180 quoting with doubled quotes, embedded newlines). Writers skip empty
results (no file, ``None``), as the protocol does.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import BATCH_COLUMNS, COMPREHENSIVE_COLUMNS, CSV_OPTIONS, path_exists

WRITE_CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    # keep texts byte-exact (Spark trims values on write by default)
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str | None:
    from ..session import materialize

    df = materialize(df, "sink")  # computed once for the emptiness test and the file
    if df.isEmpty():
        return None
    df.write.mode(mode).options(**WRITE_CSV_OPTIONS).csv(path)
    return path


def comprehensive_rows(evals: DataFrame, run_ts: str, columns=COMPREHENSIVE_COLUMNS) -> DataFrame:
    """SNK-1 projection: the 23-column layout (``timestamp`` = the run id)."""
    src = evals.withColumn("timestamp", F.lit(run_ts))
    return src.select(*columns)


def write_comprehensive(
    evals: DataFrame, results_dir: str, run_ts: str, mode: str = "errorifexists", columns=COMPREHENSIVE_COLUMNS
) -> str | None:
    """SNK-1: ``results/comprehensive_eval_<ts>.csv``; empty input -> no file, None."""
    return _csv(comprehensive_rows(evals, run_ts, columns), f"{results_dir.rstrip('/')}/comprehensive_eval_{run_ts}.csv", mode)


def write_batch_evaluation(evals: DataFrame, results_dir: str, run_ts: str, mode: str = "errorifexists") -> str | None:
    """SNK-2: ``results/batch_<ts>/evaluation.csv`` with the 21-column layout."""
    return _csv(evals.select(*BATCH_COLUMNS), f"{results_dir.rstrip('/')}/batch_{run_ts}/evaluation.csv", mode)


def write_batch_prompts(prompts_with_summary: DataFrame, out_dir: str, mode: str = "errorifexists") -> str | None:
    """SNK-3: batch input rows plus the ``ATS Summary`` column."""
    df = prompts_with_summary.withColumnRenamed("ats_summary", "ATS Summary")
    return _csv(df, f"{out_dir.rstrip('/')}/batch_prompts_output.csv", mode)


def stage_bundle(tables: dict[str, DataFrame], out_dir: str, run_id: str) -> dict[str, str]:
    """SNK-4, first step: every table of a run written to a folder of its own; no reader sees it yet."""
    base = f"{out_dir.rstrip('/')}/data/{run_id}-{uuid.uuid4().hex[:12]}"
    staged = {}
    for name, df in tables.items():
        staged[name] = f"{base}/{name}"
        df.withColumn("run_id", F.lit(run_id)).write.parquet(staged[name])
    return staged


def publish_bundle(spark: SparkSession, staged: dict[str, str], out_dir: str, run_id: str) -> str:
    """SNK-4, last step: the run's manifest appears under its name at once, naming all tables.

    The manifest is written aside and renamed; a later manifest of the same run replaces it.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = f"{out_dir.rstrip('/')}/manifest"
    number = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    aside, path = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}{number}.json") for prefix in ("_", ""))
    fs = path.getFileSystem(conf)
    out = fs.create(aside, False)
    try:
        for name, place in staged.items():
            out.write(bytearray((json.dumps({"run_id": run_id, "number": number, "name": name, "path": place}) + "\n").encode()))
    finally:
        out.close()
    if not fs.rename(aside, path):
        raise OSError(f"could not publish {path.toString()}")
    return path.toString()


def write_bundle(tables: dict[str, DataFrame], out_dir: str, run_id: str) -> dict[str, str]:
    """SNK-4: all tables of a run, visible together or not at all; the same run again replaces it."""
    spark = next(iter(tables.values())).sparkSession
    staged = stage_bundle(tables, out_dir, run_id)
    publish_bundle(spark, staged, out_dir, run_id)
    return staged


def read_bundle(spark: SparkSession, out_dir: str, name: str, run_id: str | None = None) -> DataFrame | None:
    """A table of all published runs (or of one), each from its newest manifest; None if no run has it."""
    pattern = f"{out_dir.rstrip('/')}/manifest/*.json"
    if not path_exists(spark, pattern):
        return None
    runs = spark.read.schema("run_id string, number string, name string, path string").json(pattern)
    runs = runs if run_id is None else runs.where(F.col("run_id") == run_id)
    newest = runs.groupBy("run_id").agg(F.max("number").alias("number"))
    # one path per run
    paths = [r["path"] for r in runs.join(newest, ["run_id", "number"]).where(F.col("name") == name).select("path").collect()]
    return spark.read.parquet(*paths) if paths else None


def write_run_partition(df: DataFrame, path: str) -> str:
    """Parquet partitioned by ``run_id``; only the runs present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    return path


def write_report_text(lines: DataFrame, path: str) -> str:
    """SNK-5: the numbered lines of a report as one text file, in order."""
    lines.repartition(1).sortWithinPartitions("line_no").select("value").write.mode("overwrite").text(path)
    return path


__all__ = [
    "CSV_OPTIONS",
    "WRITE_CSV_OPTIONS",
    "comprehensive_rows",
    "write_comprehensive",
    "write_batch_evaluation",
    "write_batch_prompts",
    "stage_bundle",
    "publish_bundle",
    "write_bundle",
    "read_bundle",
    "write_run_partition",
    "write_report_text",
]


FILES_IN_FOLDER = 1000
# each task puts its own files in place when it ends; by default the driver moves them all, one by one, when the job ends
FILES_BY_TASKS = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


def _store(path: str):
    """The file system of a folder as Python tasks reach it, and the folder's path there; None where they don't."""
    import re

    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    try:
        return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
    except (ValueError, OSError, NotImplementedError):
        return None


def _file_for_each_row(base: str):
    """Writes (name, value) rows in a hidden folder, which becomes the task's folder when all is written."""

    def run(batches):
        import pyarrow as pa
        from pyarrow.fs import FileType
        from pyspark import TaskContext

        store, root = _store(base)
        n, task = 0, TaskContext.get()
        hidden, done = f"{root}/_attempt-{task.taskAttemptId()}", f"{root}/task={task.partitionId():05d}"
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = f"{hidden}/{n // FILES_IN_FOLDER:05d}"
                if n % FILES_IN_FOLDER == 0:
                    store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{folder}/{name}-{n}.txt") as f:
                    f.write((value or "").encode() + b"\n")
                n += 1
        if n and store.get_file_info(done).type == FileType.NotFound:
            store.move(hidden, done)
        elif n:
            store.delete_dir(hidden)  # another attempt was first
        yield pa.RecordBatch.from_pydict({"files": [n]})

    return run


def write_text_files(df: DataFrame, base: str, name: str = "name", value: str = "value") -> None:
    """A text file for each row, ``<name>-<number>.txt``, a thousand to a folder.

    Python tasks write them, as Hadoop's local file system starts a ``chmod`` process for every file,
    checksum file and folder that it makes. In a store that only Spark reaches, Spark's writer makes a folder for each name.
    """
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value"))
    if _store(base) is None:
        rows.withColumn("file", F.concat("name", F.lit("-0"))).drop("name").write.partitionBy("file").option(*FILES_BY_TASKS).text(base)
        return
    rows.mapInArrow(_file_for_each_row(base), "files long").agg(F.sum("files")).first()
