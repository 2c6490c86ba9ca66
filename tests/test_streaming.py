"""Streaming monitors: watermark drops a late file, duplicates collapse, running stats = batch."""

import os
import time

from pyspark.sql import functions as F

from panelscore.streaming import monitor

SCHEMA = "eval_ts timestamp, target_model string, evaluator string, helpfulness double, run_id string, prompt_id long"


def _drop_files(spark, folder, batches):
    """Write each batch as its own parquet file with increasing modification times."""
    os.makedirs(folder, exist_ok=True)
    t0 = time.time() - 1000
    for i, rows in enumerate(batches):
        tmp = f"{folder}_tmp{i}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(tmp)
        part = [f for f in os.listdir(tmp) if f.endswith(".parquet")][0]
        dst = os.path.join(folder, f"f{i}.parquet")
        os.replace(os.path.join(tmp, part), dst)
        os.utime(dst, (t0 + 10 * i, t0 + 10 * i))


def _row(ts, h, pid=1, run="r1"):
    import datetime as dt

    return (dt.datetime.fromisoformat(ts), "m1", "m2", h, run, pid)


def test_late_file_two_batches_after_watermark_is_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    _drop_files(spark, src, [
        [_row("2024-01-01 10:00:00", 0.2)],
        [_row("2024-01-01 14:00:00", 0.4)],
        [_row("2024-01-01 13:30:00", 0.6)],   # 30 min behind the max, within the 1 h delay: kept
        [_row("2024-01-01 20:00:00", 0.8)],
        [_row("2024-01-01 09:30:00", 1.0)],   # far behind the watermark: dropped
    ])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    agg = monitor.windowed_cross_means(stream, window="1 hour", delay="1 hour")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = monitor.to_parquet_batches(agg, out, ck, "update")
    q.awaitTermination(300)
    res = {str(r["window_start"]): r["helpfulness_mean"] for r in monitor.read_latest(spark, out, ["window_start", "target_model", "evaluator"]).collect()}
    assert "2024-01-01 13:00:00" in res and res["2024-01-01 13:00:00"] == 0.6
    assert "2024-01-01 09:00:00" not in res
    assert set(res) == {"2024-01-01 10:00:00", "2024-01-01 14:00:00", "2024-01-01 13:00:00", "2024-01-01 20:00:00"}


def test_redelivered_judgments_collapse(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [_row("2024-01-01 10:00:00", 0.1 * i, pid=i) for i in range(5)]
    _drop_files(spark, src, [rows, rows, rows[:2]])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = monitor.to_parquet_batches(monitor.dedup_judgments(stream), out, ck, "append")
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == 5
    assert got.select("prompt_id").distinct().count() == 5


def test_running_stats_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    batches = [[_row("2024-01-01 10:00:00", v, pid=i)] for i, v in enumerate([0.1, 0.5, 0.9, None])]
    _drop_files(spark, src, batches)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = monitor.to_parquet_batches(monitor.running_model_stats(stream, ["helpfulness"]), out, ck, "complete")
    q.awaitTermination(300)
    r = monitor.read_last_batch(spark, out).collect()[0]
    assert r["n"] == 4 and abs(r["helpfulness_mean"] - 0.5) < 1e-12
    assert spark.read.parquet(out).select(F.max("batch_id")).collect()[0][0] == 3


def test_hourly_query_drops_late_rows(spark):
    from panelscore.plans import catalog

    sf = "/root/testdata/sf0.001"
    late = catalog._facts(spark, sf).where(catalog.late_rows(catalog._facts(spark, sf)))
    rows, dropped = catalog.hourly_stream(spark, sf)
    # entries are counted after the partial aggregation of a batch
    assert 0 < dropped <= late.count()
    assert rows.count() > 0
