"""Mixing sources to target weights (DataFrame functions only).

Temperature mixing: a source with token share p gets the weight ``p ** a``, normalised.
The exponent ``a`` in [0, 1] is bisected to the largest value (closest to the raw shares)
at which the weights' entropy reaches ``target_entropy``, or to the smallest one
(closest to equal weights) at which no source is repeated more than ``max_epochs`` times.

The budget is realised as block permutations: a document belongs to one block of its
source by the hash of its id and text (rows without an id: of text and row number); in every epoch the blocks of a source are put in a
new hash order, and documents inside a block too. A source gives whole epochs, then
whole blocks of the next one, then the documents at the head of one last block, until its
tokens (weight x budget) are used; a document whose first token lies inside the quota is
taken. With ``budget=None`` the budget is the least one at which every source is
used at least once, so no document is lost.

Scale: documents are aggregated to (source, block) token sums before any ordering. The blocks of a
source (about ``block_tokens`` tokens each) are ranked inside 1,024 ranges of their order hash, to which
the counts of the ranges before are added; inside the one boundary block of a source and epoch a window
runs over its documents. A source with a third of all rows is never in one task, neither as documents
nor as blocks, and rows without an id are dealt over its blocks too. Sources are not collected: each pass
evaluates the 63 exponents that six bisection steps can visit, in one aggregation.

Defined results: a null source is a source of its own; null and blank texts count no tokens and
are taken with their block in each epoch; an empty table gives an empty result; ids may repeat, and rows
equal in id and text share block and place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK_TOKENS = 200_000
MAX_EPOCHS = 4.0


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(common.words_of(text)).cast("long")


def _moments(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For every exponent a: sum p^a, sum p^a ln p, max p^(a-1) over the sources with tokens."""
    p = F.col("share")
    cols = []
    for i, a in enumerate(exponents):
        w = F.pow(p, F.lit(a))
        cols += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(p)).alias(f"l{i}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"m{i}"), F.min(F.pow(p, F.lit(a - 1))).alias(f"n{i}")]
    row = sources.where("share > 0").agg(*cols).first()
    return [(row[f"z{i}"], row[f"l{i}"], row[f"m{i}"], row[f"n{i}"]) for i in range(len(exponents))]


def entropy(z: float, logs: float, a: float) -> float:
    """Entropy (nats) of the weights p^a / z, given sum p^a ln p."""
    return math.log(z) - a * logs / z


def epochs(z: float, most: float, least: float, budget: float | None, total: float) -> float:
    """Times that the most repeated source is used. A source's share of the budget over its tokens is
    (p^a / z) budget / (p total); without a budget the least used source is used once."""
    return most / least if budget is None else most / z * budget / total


def find_exponent(
    sources: DataFrame, target_entropy: float | None, max_epochs: float | None, budget: float | None, total: float, steps: int = 30
) -> tuple[float, float, float]:
    """(exponent, sum p^a, least p^(a-1)); entropy falls and repeats fall as the exponent grows to 1."""

    def fits(a, moments) -> bool:
        z, logs, most, least = moments
        if target_entropy is not None:
            # the wanted exponent is the largest with enough entropy: "too large" when there is less
            return entropy(z, logs, a) < target_entropy
        return epochs(z, most, least, budget, total) <= (max_epochs or MAX_EPOCHS)

    # fits(a) is false, then true, as a grows; lo does not fit, hi does
    lo, hi = 0.0, 1.0
    first, last = _moments(sources, [lo, hi])
    if fits(lo, first):
        return lo, first[0], first[3]
    if not fits(hi, last):
        return hi, last[0], last[3]
    done = 0
    while done < steps:
        width = (hi - lo) / 64
        tried = [lo + width * i for i in range(1, 64)]
        found = _moments(sources, tried)
        a, b = 0, 64  # bisection over the exponents of this pass
        while b - a > 1:
            mid = (a + b) // 2
            if fits(tried[mid - 1], found[mid - 1]):
                b = mid
            else:
                a = mid
        lo, hi = lo + width * a, lo + width * b
        done += 6
    a = lo if target_entropy is not None else hi
    (m,) = _moments(sources, [a])
    return a, m[0], m[3]


def mix(
    docs: DataFrame,
    budget: float | None = None,
    target_entropy: float | None = None,
    max_epochs: float | None = MAX_EPOCHS,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 0,
) -> DataFrame:
    """One row per use of a document: rid, doc_id, source, n_tokens, epoch, block_rank, place, weight, exponent.

    ``epoch`` counts from 0; rows in the order (epoch, block_rank, place) are the training order of a source.
    ``rid`` numbers the rows of the written copy of ``docs`` and tells repeated ids apart.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("salt")
    )
    return _realise(common.written(rows, "mix-rows"), budget, target_entropy, max_epochs, block_tokens, seed)


def _realise(rows: DataFrame, budget, target_entropy, max_epochs, block_tokens, seed) -> DataFrame:
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    sources = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    sources = common.written(sources, "mix-sources")
    total = sources.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    if total:
        shares = sources.withColumn("share", F.col("tokens") / F.lit(float(total)))
        a, z, least = find_exponent(shares, target_entropy, max_epochs, budget, float(total))
        spend = float(budget) if budget is not None else total * z / least
        weight = F.when(F.col("share") > 0, F.pow("share", F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0))
        plan = shares.withColumn("weight", weight).withColumn("exponent", F.lit(a))
        plan = plan.withColumn("quota", F.round(F.col("weight") * F.lit(spend)).cast("long"))
    else:
        plan = sources.withColumn("weight", F.lit(0.0)).withColumn("exponent", F.lit(1.0)).withColumn("quota", F.lit(0).cast("long"))
    if budget is None:
        # rounding must not cost the last document of a source that is used once
        plan = plan.withColumn("quota", F.greatest("quota", "tokens"))
    plan = plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long"))
    # a source without tokens gives its rows once if nothing is to be lost
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1 if budget is None else 0)).cast("long"))
    plan = plan.select(F.col("source").alias("__s"), "tokens", "weight", "exponent", "quota", "blocks", "full")
    plan = common.written(plan, "mix-plan")

    named = F.col("doc_id").isNotNull()
    number = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "doc_id", "salt", F.when(~named, F.col("rid"))), F.col("blocks"))
    # the plan has one row per source; Spark broadcasts it below its own size limit, else a source's rows are split as skew
    placed = rows.join(plan, same("source", "__s")).withColumn("block", number)
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block")).join(plan, same("source", "__s"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    order = F.xxhash64(F.lit(seed), F.lit("order"), "epoch", "source", "block")
    blocks = common.written(blocks.withColumn("turn", order).withColumn("range", F.shiftright("turn", 54)), "mix-blocks")
    # ranks inside ranges of the order hash, and what the ranges before hold
    turn = Window.partitionBy("source", "epoch", "range").orderBy("turn", "block")
    earlier = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("source", "epoch", "range").agg(F.count("*").alias("n"), F.sum("in_block").alias("t"))
    ranges = ranges.select(
        F.col("source").alias("__rs"), F.col("epoch").alias("__re"), F.col("range").alias("__rr"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ranked"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("spent"),
    )
    blocks = blocks.join(ranges, same("source", "__rs") & (F.col("epoch") == F.col("__re")) & (F.col("range") == F.col("__rr")))
    blocks = blocks.withColumn("block_rank", F.col("ranked") + F.row_number().over(turn)).withColumn(
        "before", F.col("spent") + F.coalesce(F.sum("in_block").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    left = F.col("quota") - F.col("full") * F.col("tokens") - F.col("before")
    blocks = blocks.withColumn("left", F.when(F.col("epoch") < F.col("full"), F.lit(None).cast("long")).otherwise(left))
    blocks = blocks.where("left is null or left > 0").withColumn("whole", F.col("left").isNull() | (F.col("in_block") <= F.col("left")))
    uses = blocks.select(F.col("source").alias("__bs"), F.col("block").alias("__bb"), "epoch", "block_rank", "left", "whole")
    uses = common.written(uses, "mix-uses")

    used = placed.join(uses, same("source", "__bs") & (F.col("block") == F.col("__bb")))
    place = F.xxhash64(F.lit(seed), F.lit("place"), "epoch", "doc_id", "salt", F.when(~named, F.col("rid")))
    columns = ["rid", "doc_id", "source", "n_tokens", "epoch", "block_rank", place.alias("place"), "weight", "exponent"]
    whole = used.where("whole").select(*columns)
    # the one block of a source that is used in part: its documents in order, up to the tokens that are left
    part = Window.partitionBy("source", "block", "epoch").orderBy("place", "doc_id", "rid")
    edge = used.where("not whole").select(*columns, "block", "left")
    edge = edge.withColumn("before", F.coalesce(F.sum("n_tokens").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return whole.union(edge.where("before < left").select(*[c if isinstance(c, str) else "place" for c in columns]))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents of the mixture with the columns of ``docs``; a document used k times is there k times."""
    columns = docs.columns
    kept = common.written(docs.withColumn("__rid", F.monotonically_increasing_id()), "mix-docs")
    rows = kept.select(
        F.col("__rid").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("salt")
    )
    p = {"budget": None, "target_entropy": None, "max_epochs": MAX_EPOCHS, "block_tokens": BLOCK_TOKENS, "seed": 0} | params
    uses = _realise(common.written(rows, "mix-rows"), p["budget"], p["target_entropy"], p["max_epochs"], p["block_tokens"], p["seed"])
    times = uses.groupBy("rid").agg(F.count("*").alias("__times"))
    out = kept.join(times, kept["__rid"] == times["rid"])
    return out.withColumn("__use", F.explode(F.sequence(F.lit(1).cast("long"), "__times"))).select(*columns)
