"""Exact sums and rounding against Python's own arithmetic."""

import math
import random

from pyspark.sql import functions as F

from panelscore.config import METRICS
from panelscore.functions import exact
from panelscore.operators import scoring

SF_SMALL = "/root/testdata/sf0.001"
FIVE = [f"model_{c}" for c in "abcde"]


def means(spark, groups, parts=5):
    rows = [(g, x) for g, xs in enumerate(groups) for x in [*xs, None]]
    df = exact.with_parts(spark.createDataFrame(rows, "g int, x double").repartition(parts), {"x": "x"})
    agg = df.groupBy("g").agg(*exact.sum_aggregates(["x"]), F.count("x").alias("n"))
    out = agg.select("g", "n", exact.exact_sums(["x"])[0].alias("s")).select("*", F.try_divide("s", F.col("n").cast("double")).alias("m"))
    return {r["g"]: r for r in out.select("*", exact.py_round("m").alias("r")).collect()}


def drawn(rng, kind):
    if kind == 0:
        return rng.randint(0, 100) / 100
    if kind == 1:
        return round(rng.uniform(-5, 10), rng.choice([1, 2, 3]))
    if kind == 2:
        return rng.random()
    if kind == 3:
        return math.ldexp(rng.uniform(-1, 1), rng.randint(-1070, 1000))
    if kind == 4:
        return rng.choice([1e300, -1e300, 1e25, -1e25, 5e-324, 1e-300, 0.1, 0.3, 2.0**31, -(2.0**62), 0.0, -0.0, 0.001, 0.0005, 1.5])
    return round(rng.random() * 0.01, 5)


def test_sums_of_the_full_range_are_exact(spark):
    rng = random.Random(5)
    groups = []
    for _ in range(2500):
        kind = rng.randrange(7)
        groups.append([drawn(rng, kind if kind < 6 else rng.randrange(6)) for _ in range(rng.randint(0, 6))])
    got = means(spark, groups)
    for g, xs in enumerate(groups):
        assert got[g]["s"] == math.fsum(xs), xs
        if xs:
            assert got[g]["r"] == round(math.fsum(xs) / len(xs), 3), xs
        else:
            assert got[g]["r"] is None


def test_hundredths_of_four_judges(spark):
    rng = random.Random(6)
    groups = [[0.57, 0.65, 0.21, 0.18]] + [[rng.randint(0, 100) / 100 for _ in range(4)] for _ in range(4000)]
    got = means(spark, groups)
    assert got[0]["r"] == 0.402
    assert all(got[g]["s"] == sum(xs) for g, xs in enumerate(groups))  # compensated in Python 3.12 and later
    assert all(got[g]["r"] == round(sum(xs) / len(xs), 3) for g, xs in enumerate(groups))


def test_order_and_partitions_change_nothing(spark):
    xs = [1e300, 1.0, 0.1, -1e300, 1e-20, 0.3, 2.0**40]
    assert len({means(spark, [p], parts)[0]["s"] for p in (xs, xs[::-1], sorted(xs)) for parts in (1, 4)}) == 1


def test_infinities_do_not_abort(spark):
    got = means(spark, [[math.inf, 1.0], [math.inf, -math.inf], [1e308, 1e308]])
    assert got[0]["s"] == math.inf and math.isnan(got[1]["s"]) and got[2]["s"] == math.inf


def test_rounding_equals_python(spark):
    rng = random.Random(7)
    ties = [(2 * k + 1) / 2000 for k in range(1000)]
    xs = [0.0625, 0.1875, 0.3125, 2.0005, 2.675, 1e15 + 0.5, 123456.0625, 4398046511104.0625, 8796093022208.001, -0.0625, -2.5005, 5e-324, 1e300, -0.0]
    xs += ties + [17 + t for t in ties] + [math.nextafter(t, d) for t in ties for d in (0, 1)] + [rng.random() * 10 ** rng.randint(-4, 6) for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 1, 2, 3):
        for r in df.select("x", exact.py_round("x", digits).alias("r")).collect():
            assert r["r"] == round(r["x"], digits), (r["x"], digits)


def test_averages_of_the_five_judge_fixture_equal_python(spark):
    """Every cell of AGG-5 from the parsed scores, by ``round(sum(x) / len(x), 3)``."""
    from panelscore.plans import fixtures as fx

    parsed = scoring.parsed_judgments(fx.judgments_raw(spark, SF_SMALL, FIVE))
    scores: dict = {}
    for r in parsed.where("status = 'ok'").collect():
        cell = scores.setdefault((r["prompt_id"], r["target_model"]), {m: [] for m in METRICS})
        for m in METRICS:
            if r[f"num_{m}"] is not None:
                cell[m].append(r[f"num_{m}"])
    got = scoring.target_averages(parsed).collect()
    assert len(got) == len(scores) > 100
    for r in got:
        for m, xs in scores[(r["prompt_id"], r["target_model"])].items():
            assert r[f"avg_{m}"] == (round(sum(xs) / len(xs), 3) if xs else 0.5)


def test_a_huge_score_does_not_abort(spark):
    rows = [(1, "a", e, f'{{"helpfulness": {v}, "reasoning": "x"}}') for e, v in (("b", "1e25"), ("c", "0.5"), ("d", "1e300"))]
    raw = spark.createDataFrame(rows, "prompt_id long, target_model string, evaluator string, raw_text string")
    got = scoring.target_averages(scoring.parsed_judgments(raw)).collect()
    assert len(got) == 1 and got[0]["avg_helpfulness"] == round(sum([1e25, 0.5, 1e300]) / 3, 3) and got[0]["avg_clarity"] == 0.5
