"""Session helpers: defaults for tests/bench and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# SQL settings every query relies on; all are runtime-settable, so queries
# re-apply them on whatever session the caller hands in.
QUERY_CONF = {
    # Judges sometimes repeat a key; the last one wins, as in most JSON readers.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}


def apply_query_conf(spark: SparkSession) -> None:
    for k, v in QUERY_CONF.items():
        spark.conf.set(k, v)
    ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``panelscore`` importable in Python workers (once per application).

    Python tasks (``mapInPandas``) unpickle references to this package, so the
    executors need it on their path: the package is zipped on the driver and
    registered with ``addPyFile`` (the same as ``--py-files`` at submit time).
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="panelscore-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "panelscore") -> SparkSession:
    """Session for tests and the local bench (cluster jobs get theirs from spark-submit)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in QUERY_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only when none is configured.

    On a cluster ``spark.checkpoint.dir`` names shared storage (HDFS/S3); it is read,
    never overridden, and a cluster session without it is an error. Only local-mode
    runs without the setting (tests, the local bench) get a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local"):
        # executors on other machines could not read a driver-local folder
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (HDFS, S3, ...)")
    local = tempfile.mkdtemp(prefix="panelscore-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint location for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "stage"):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Used where one intermediate feeds several branches of a plan: the written
    table cuts the lineage (an executor loss re-reads files instead of
    recomputing) and every branch reads the same result.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class conf_override:
    """Temporarily set SQL confs (restored on exit), e.g. while a stream starts."""

    def __init__(self, spark: SparkSession, values: dict):
        self.spark, self.values, self.saved = spark, values, {}

    def __enter__(self):
        for k, v in self.values.items():
            self.saved[k] = self.spark.conf.get(k, None)
            self.spark.conf.set(k, str(v))
        return self

    def __exit__(self, *exc):
        for k, v in self.saved.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)
        return False
