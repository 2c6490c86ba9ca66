"""Block-matrix whitening against numpy."""

import math

import numpy as np
import pytest

from panelscore.llm import whitening


def expected(vectors, k):
    x = np.array([np.floor(64 * np.asarray(v, dtype=float)) + 1_000_000 for v in vectors])
    unique = np.unique(x, axis=0)
    n, s = len(unique), unique.sum(0)
    c = unique - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(k, x.shape[1])
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, exact, (x - s / n) @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def held(got, vectors, k):
    n, deviation, white, explained = expected(vectors, k)
    rows = sorted(got, key=lambda r: (r["vec_id"], r["component"]))
    k = white.shape[1]
    assert len(rows) == len(vectors) * k
    assert {r["n"] for r in rows} == {n}
    w = np.array([r["whitened"] for r in rows]).reshape(-1, k)
    sign = np.sign((w * white).sum(0))
    assert np.abs(w - white * sign).max() < 1e-8
    assert [r["deviation"] for r in rows[::k]] == deviation
    assert np.allclose([r["explained"] for r in rows[:k]], explained, rtol=1e-9)
    assert rows[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in rows}) == 1


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)


def test_sample_table(spark, sample_dir):
    emb = spark.read.parquet(f"{sample_dir}/embeddings.parquet")
    data = sorted(emb.collect(), key=lambda r: r["vec_id"])
    held(whitening.whitened_components(emb).collect(), [r["embedding"] for r in data], 16)


@pytest.mark.parametrize("block,split", [(7, 1), (64, 3)])
def test_many_small_blocks_and_copies(spark, monkeypatch, block, split):
    monkeypatch.setattr(whitening, "SPLIT_BLOCKS", split)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 5)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist(), 0) for i in range(100)]
    wide = whitening.whiten(table(spark, rows), 16, rows_per_block=block)
    got = [
        {"vec_id": r["vec_id"], "component": c + 1, "n": r["n"], "deviation": r["deviation"], "whitened": w, "explained": r["explained"][c], "identity_error": r["identity_error"]}
        for r in wide.collect()
        for c, w in enumerate(r["whitened"])
    ]
    held(got, [v for _, v, _ in sorted(rows)], 16)


def test_bad_rows_go_and_ids_repeat(spark):
    rng = np.random.default_rng(2)
    good = [(i % 3 if i else None, rng.normal(size=3).astype(np.float32).tolist(), None) for i in range(20)]
    bad = [(50, None, 1), (51, [1.0, None, 2.0], 1), (52, [1.0, math.nan, 0.0], 1), (53, [1.0, math.inf, 0.0], 1), (54, [], 1), (55, [1.0, 2.0], 1)]
    df = table(spark, good + bad).withColumnRenamed("label", "n")
    got = whitening.whitened_components(df).collect()
    assert len(got) == 20 * 3
    assert not {r["vec_id"] for r in got} & {50, 51, 52, 53, 54, 55}
    assert sum(r["vec_id"] is None for r in got) == 3


def test_no_rows_and_no_variance(spark):
    assert whitening.whitened_components(table(spark, [(1, None, 0)])).count() == 0
    assert whitening.whitened_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    same = whitening.whitened_components(table(spark, [(i, [1.0, 2.0], 0) for i in range(9)])).collect()
    assert len(same) == 18 and all(r["whitened"] is None and r["n"] == 1 and r["deviation"] == 0 and r["explained"] == 0 for r in same)
    # the second dimension never changes: one live component
    flat = whitening.whitened_components(table(spark, [(i, [float(i), 2.0], 0) for i in range(9)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)}
    assert flat[0]["identity_error"] < 1e-9


def test_entries_beyond_the_grid_are_bounded(spark):
    rows = [(0, [3e38, 0.0], 0), (1, [-3e38, 1.0], 0), (2, [0.0, 2.0], 0)]
    got = whitening.whitened_components(table(spark, rows)).collect()
    assert len(got) == 6 and all(r["deviation"] is None for r in got if r["vec_id"] < 2)
