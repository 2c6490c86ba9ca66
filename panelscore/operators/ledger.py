"""Ledger of paid model calls (INF-1..6): a finished call is never paid for again.

A call is named by a hash of its role, model and request. Tasks commit finished calls, a few at a
time, as small parquet files in the ledger folder: written aside, then renamed, so a reader sees a
whole file or none. Requests are dealt by that name; a retried task first reads what earlier attempts
of its share have committed. A rerun joins the requests with the whole ledger and calls only for the rest.
Failed calls are not committed: a rerun tries them again.

The folder must be shared by the cluster and outlive the job (``file:``, ``hdfs:``, ``s3:``/``s3a:``, ``gs:``).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = pa.schema([("call_key", pa.string()), ("text", pa.string())])
SPARK_SCHEMA = "call_key string, text string"


def call_key(role: str, model: Column, request: Column) -> Column:
    """Name of a call, as a Column (the same as ``key_of``)."""
    parts = [F.lit(role), F.coalesce(model, F.lit("")), F.coalesce(request, F.lit(""))]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def key_of(role: str, model: str | None, request: str | None) -> str:
    return hashlib.sha256("\x1f".join([role, model or "", request or ""]).encode()).hexdigest()


def committed(spark: SparkSession, folder: str) -> DataFrame | None:
    """All committed calls, one row per name; None if the ledger is empty."""
    from ..sources.files import path_exists

    pattern = f"{folder.rstrip('/')}/share=*/*.parquet"
    if not path_exists(spark, pattern):
        return None
    return spark.read.schema(SPARK_SCHEMA).parquet(pattern).groupBy("call_key").agg(F.min("text").alias("text"))


class TaskLedger:
    """A task's share of the ledger."""

    def __init__(self, folder: str, share: str):
        uri = folder.replace("s3a://", "s3://", 1)
        self.fs, base = pafs.FileSystem.from_uri(uri)
        self.base = f"{base.rstrip('/')}/share={share}"

    def read(self) -> dict[str, str | None]:
        """Calls that earlier attempts of this share have committed."""
        found = self.fs.get_file_info(pafs.FileSelector(self.base, allow_not_found=True))
        out: dict[str, str | None] = {}
        for f in found:
            if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith("_"):
                table = pq.read_table(f.path, filesystem=self.fs, schema=SCHEMA)
                out.update(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
        return out

    def commit(self, calls: Iterable[tuple[str, str | None]]) -> None:
        """Finished calls as one file, visible as a whole."""
        calls = list(calls)
        if not calls:
            return
        self.fs.create_dir(self.base, recursive=True)
        name = uuid.uuid4().hex
        aside = f"{self.base}/_{name}"
        pq.write_table(pa.Table.from_arrays([pa.array(c, pa.string()) for c in zip(*calls)], schema=SCHEMA), aside, filesystem=self.fs)
        self.fs.move(aside, f"{self.base}/{name}.parquet")
