"""Join helpers: size-checked broadcast, numbering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Most bytes of text that a checked broadcast may hold.
BROADCAST_BYTES = 256 << 20


def bounded_broadcast(small: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``small`` only if it provably holds at most ``max_rows`` rows and ``max_bytes`` bytes of text.

    The check reads ``limit(max_rows + 1)``, which stops once the row bound is exceeded, and adds up
    the lengths of its string columns (other columns are short). Beyond a bound the frame is
    returned unhinted, so Spark plans a shuffle join (and AQE may still convert it from runtime sizes).
    """
    text = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") for f in small.schema.fields if isinstance(f.dataType, StringType)]
    size = F.coalesce(F.sum(reduce(lambda x, y: x + y, text)), F.lit(0)) if text else F.lit(0).cast("long")
    n, size = small.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return F.broadcast(small) if n <= max_rows and size <= max_bytes else small


def spread(df: DataFrame) -> DataFrame:
    """Spread CPU-heavy per-row work when the input has fewer partitions than cores.

    Large inputs (many files / row groups) already have more partitions than the
    cluster has cores and are returned unchanged; a small input stored as one
    row group would otherwise run its whole map stage in a single task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, per_core: int = 4) -> DataFrame:
    """Rows dealt evenly over ``per_core`` partitions a core, whatever their bytes.

    For short rows that cost much further on: AQE joins partitions by their bytes, so without a
    fixed number all of them can stand in one task.
    """
    return df.repartition(per_core * df.sparkSession.sparkContext.defaultParallelism)


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """A number for each of ``n`` hash partitions: ``repartition(n, key)`` gives each its own (hashes of 0, 1, .. meet in some)."""
    ids = spark.range(32 * n + 64)
    part = F.pmod(F.hash("id"), F.lit(n))
    return sorted(r[0] for r in ids.groupBy(part.alias("part")).agg(F.min("id")).select("min(id)").collect())


def running_offsets(sizes: DataFrame, keys: Sequence[str], size: str = "n", name: str = "first") -> DataFrame:
    """``keys, first``: how many rows come before each part, parts in the order of ``keys`` (one short row per part)."""
    earlier = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*keys, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(name))


def numbered(df: DataFrame, by: Sequence, name: str) -> DataFrame:
    """Rows in the order of ``by`` with a number from 1 in ``name``.

    A range sort is written once with each row's partition and place; only the counts per partition
    are added up, so no task sees all rows.
    """
    from ..session import materialize

    at = F.monotonically_increasing_id()
    place = [F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos")]
    kept = materialize(df.orderBy(*by).select("*", *place), "numbered")
    offsets = running_offsets(kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n")), ["_part"], name="_first")
    out = kept.join(bounded_broadcast(offsets, 1_000_000), "_part")
    return out.select(*df.columns, (F.col("_first") + F.col("_pos") + 1).alias(name))
