"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize, ship_package

# ASCII white space of the operator contracts: [\x20\x09-\x0D]
SPACES = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors and the shared checkpoint folder known."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once under the shared checkpoint folder (lineage is cut there)."""
    prepare(df.sparkSession)
    return materialize(df, f"llm-{name}")


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def without(col: Column, chars: str, by: str = "") -> Column:
    """``col`` with each of ``chars`` replaced (byte searches, much cheaper than translate)."""
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(by)), chars, col)


def words_of(col: Column) -> Column:
    """ASCII-white-space words of a text (null and blank texts give an empty array)."""
    return F.array_remove(F.split(without(text_or_empty(col), SPACES[1:], " "), " "), "")


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` in batches that arrive sorted by it, one table per run.

    Only the run at the end of a batch is carried over, so memory is one batch plus one run.
    """
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and keys[a] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected edge list: DataFrame(node, label), label equal within a component.

    Contraction: each round maps every node to the neighbour (or itself) with the
    least hash for that round, rewrites the edges to the mapped ends and drops
    loops and repeats; the hashes are new in each round, so the number of nodes
    falls by a constant factor whatever the ids are. A node's label is found by
    following the mappings. Neighbour minima are aggregated before the shuffle, so
    a hub costs one row per task; edges and maps never leave the executors.
    """
    cur = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct()
    cur = written(cur, "cc-edges")
    labels = None
    for k in range(max_rounds):
        if cur.isEmpty():
            break
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("o"), c.alias("id"))
        step = both.groupBy("a").agg(F.least(F.min(order(F.col("b"))), order(F.col("a")))["id"].alias("to"))
        step = written(step.select(F.col("a").alias("node"), "to"), "cc-map")
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            m = step.select(F.col("node").alias("label"), F.col("to").alias("next"))
            labels = labels.join(m, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        labels = written(labels, "cc-labels")
        ma = step.select(F.col("node").alias("a"), F.col("to").alias("na"))
        mb = step.select(F.col("node").alias("b"), F.col("to").alias("nb"))
        nxt = cur.join(ma, "a").join(mb, "b").where("na <> nb")
        nxt = nxt.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
        cur = written(nxt, "cc-edges")
    else:
        raise RuntimeError("connected components did not converge")
    if labels is None:
        labels = edges.sparkSession.createDataFrame([], "node long, label long")
    return labels
