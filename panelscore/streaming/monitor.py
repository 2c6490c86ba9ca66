"""Streaming score monitors (STM-1..3) on Structured Streaming.

Evaluation files arrive in a folder; the monitors keep running statistics,
windowed means with late-data handling, and drop re-delivered judgments.
Results go to parquet through ``foreachBatch`` (one folder per query, each
batch tagged with its id) so the sink is replayable and idempotent under
retries; ``read_latest`` resolves the current value per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import CORE4


def file_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None, bytes_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream (explicit schema, micro-batches bounded by files or bytes)."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(path)


def running_model_stats(stream: DataFrame, metrics: Sequence[str] = CORE4) -> DataFrame:
    """STM-1: running count and mean per target model (null targets dropped)."""
    return stream.where(F.col("target_model").isNotNull()).groupBy("target_model").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"{m}_mean") for m in metrics]
    )


def windowed_cross_means(
    stream: DataFrame, time_col: str = "eval_ts", window: str = "1 hour", delay: str = "1 day",
    metric: str = "helpfulness",
) -> DataFrame:
    """STM-2: tumbling-window mean per (target, evaluator); rows later than ``delay`` are dropped."""
    ts = F.col(time_col).cast("timestamp")
    s = stream.where(F.col("target_model").isNotNull()).withColumn("_ts", ts).withWatermark("_ts", delay)
    g = s.groupBy(F.window("_ts", window).alias("w"), "target_model", "evaluator").agg(
        F.count(F.lit(1)).alias("n"), F.avg(metric).alias(f"{metric}_mean")
    )
    return g.select(F.col("w.start").alias("window_start"), "target_model", "evaluator", "n", f"{metric}_mean")


def dedup_judgments(
    stream: DataFrame, keys: Sequence[str] = ("run_id", "prompt_id", "target_model", "evaluator"),
    time_col: str = "eval_ts", delay: str = "1 hour",
) -> DataFrame:
    """STM-3: keep the first delivery of each judgment key within the watermark."""
    s = stream.withColumn("_ts", F.col(time_col).cast("timestamp")).withWatermark("_ts", delay)
    return s.dropDuplicatesWithinWatermark(list(keys)).drop("_ts")


def to_parquet_batches(result: DataFrame, out_path: str, checkpoint: str, mode: str,
                       available_now: bool = True, state_partitions: int | None = None) -> StreamingQuery:
    """Sink every micro-batch to ``out_path`` tagged with ``batch_id`` (idempotent per batch).

    The number of state partitions of a stateful stream is fixed when it first
    starts; it defaults to the cluster's core count (``defaultParallelism``)
    rather than the session's batch shuffle setting.
    """
    from ..session import conf_override

    def write(batch: DataFrame, batch_id: int):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    spark = result.sparkSession
    n = state_partitions or spark.sparkContext.defaultParallelism
    w = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w
    with conf_override(spark, {"spark.sql.shuffle.partitions": n}):
        return w.start()


def dropped_late(query: StreamingQuery) -> int:
    """Entries that the state operators of a finished query dropped as later than the watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def read_appended(spark: SparkSession, out_path: str) -> DataFrame:
    """Append-mode result: every batch holds rows that never change again."""
    return spark.read.parquet(out_path).drop("batch_id")


def read_latest(spark: SparkSession, out_path: str, keys: Sequence[str]) -> DataFrame:
    """Current value per key: the row from the newest batch that emitted the key."""
    df = spark.read.parquet(out_path)
    cols = [c for c in df.columns if c not in set(keys) | {"batch_id"}]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("_v"))
    return latest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols])


def read_last_batch(spark: SparkSession, out_path: str) -> DataFrame:
    """Complete-mode result: only the newest batch holds the whole table."""
    df = spark.read.parquet(out_path)
    last = df.select(F.max("batch_id")).scalar()
    return df.where(F.col("batch_id") == last).drop("batch_id")
