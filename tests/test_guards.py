"""Scale guards: size-checked broadcast, adaptive spread, shared scratch folder."""

import pytest

from panelscore import session
from panelscore.operators.joins import bounded_broadcast, spread


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_only_within_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only explicit hints may broadcast
    try:
        big = spark.range(5000).withColumnRenamed("id", "k")
        small = spark.range(10).withColumnRenamed("id", "k")
        assert "BroadcastExchange" in _plan(big.join(bounded_broadcast(small, 100), "k"))
        assert "BroadcastExchange" not in _plan(big.join(bounded_broadcast(spark.range(500).withColumnRenamed("id", "k"), 100), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_only_small_inputs(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == cores
    many = spark.range(100).repartition(cores * 2)
    assert spread(many) is many


class _FakeSC:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None


class _FakeConf:
    def get(self, key, default=None):
        return default


class _FakeSpark:
    def __init__(self, master):
        self.sparkContext = _FakeSC(master)
        self.conf = _FakeConf()


def test_cluster_without_shared_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_FakeSpark("yarn"))
