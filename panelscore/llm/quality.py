"""Quality rules: base rules and a hashed n-gram log-likelihood ratio (DataFrame functions only).

The verdict: word unigrams and bigrams are hashed into ``buckets`` cells. Two
multinomials over the cells are estimated, one from the trusted target (documents
labelled good) and one from the raw corpus (every document), both with add-``alpha``
smoothing. A document's score is the mean over its n-grams of
``ln p_target - ln p_raw``, i.e. the log-likelihood ratio normalised by length.
Every document with ``score >= threshold`` passes; there is no draw. With
``threshold=None`` the threshold is calibrated: one in ``CALIBRATION_FOLDS`` good documents
(by id hash) is left out of the target, and the threshold is the cut that best separates
their scores from those of the documents labelled bad, in the middle of the gap between
the two sides of the cut. It follows the corpus, as scores of unseen documents
fall when there is little text to learn from.

Scale: counts of a cell are aggregated before the shuffle (at most ``buckets`` rows
per task); the two broadcast tables are bounded by parameters, ``buckets`` cells and
``max_target`` ids of trusted documents (beyond it, those with the smallest id hash are
used, the documented bound of the fitting sample; the raw counts always cover all rows).

Defined results: null or blank text has no words, fails the base rules and has a null
score; a label table without good documents gives every score 0; a null doc_id is
never a trusted document; extra columns are ignored. Calibration reads a histogram of the
scores (at most ``2 * SCORE_LIMIT / STEP`` bins); without a document on both of its sides the
threshold is ``THRESHOLD``, and of equally good cuts the lowest is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 15
MAX_TARGET = 50_000
#: Threshold where none is calibrated.
THRESHOLD = -0.2
CALIBRATION_FOLDS = 5
#: Width of a bin and outer edge of the bins in which scores are counted for calibration.
STEP, SCORE_LIMIT = 0.005, 10.0
ALPHA = 1.0
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
MAX_REPEAT_PCT = 50


def with_words(docs: DataFrame) -> DataFrame:
    """``rid`` (a row number), ``doc_id``, ``text``, its words ``w`` and its lines with a word, ``lines``."""
    blank = lambda x: common.without(x, common.SPACES) == ""
    return docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        common.text_or_empty(F.col("text")).alias("text"),
        common.words_of(F.col("text")).alias("w"),
        F.filter(F.split(common.text_or_empty(F.col("text")), "\n"), lambda x: ~blank(x)).alias("lines"),
    )


def base_columns() -> dict[str, Column]:
    """The counts that need no look at word order, over the columns of :func:`with_words`."""
    return {
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(common.without(F.col("text"), SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    }


def window_hashes(words: Column, k: int) -> Column:
    """64-bit hashes of the k-word windows, in order (empty if there are fewer words)."""
    at = lambda i, j: F.get(words, i + F.lit(j))
    idx = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) >= k, F.transform(idx, lambda i: F.xxhash64(*[at(i, j) for j in range(k)]))).otherwise(
        F.array().cast("array<bigint>")
    )


def repeated_positions(ordered: str) -> Column:
    """Start positions of the windows whose hash occurs more than once, ascending.

    ``ordered`` names a column with the (hash, position) pairs of a text, sorted.
    """
    same = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
    hits = F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1))
    return F.sort_array(F.transform(hits, lambda x: x["i"]))


def covered(positions: str, k: int) -> Column:
    """Words covered by the k-word windows that start at the (ascending) positions."""
    gaps = F.zip_with(positions, F.slice(positions, 2, F.greatest(F.size(positions) - 1, F.lit(0))), lambda p, q: F.least(q - p, F.lit(k)))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)


def ngram_cells(words: Column, buckets: int) -> Column:
    """Cells of the word unigrams and bigrams of a text."""
    uni = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    bi = F.zip_with(
        words,
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int")),
    )
    return F.concat(uni, F.filter(bi, lambda x: x.isNotNull()))


def trusted_ids(labels: DataFrame, max_target: int = MAX_TARGET) -> DataFrame:
    """Ids of the trusted documents, at most ``max_target`` of them (those with the smallest id hash)."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    n = good.count()
    if n <= max_target:
        return good
    # the hash is uniform: a first cut leaves little to sort
    share = min(1.0, 1.1 * max_target / n + 0.01)
    cut = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return cut.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id").limit(max_target)


def left_out(doc_id: str = "doc_id") -> Column:
    """Whether a good document is kept out of the target, to calibrate the threshold."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.lit("calibration")), F.lit(CALIBRATION_FOLDS)) == 0


def best_cut(bins: list[tuple[int, int, int]]) -> float:
    """Threshold from (bin, good, bad) counts: the largest kept share of the good plus rejected share of the bad."""
    bins = sorted(bins)
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return THRESHOLD
    best, at, worth, below = 1.0, bins[0][0] * STEP, 1.0, bins[0][0]
    for b, g, n in bins:
        # the cut below this bin: all lower bins are rejected
        if worth > best + 1e-12:
            best, at = worth, (below + 1 + b) / 2 * STEP
        worth += n / bad - g / good
        below = b
    return round(at, 6)


def calibrated(scored: DataFrame, labels: DataFrame) -> float:
    """The threshold that best separates left-out good documents from bad ones (see the module's text)."""
    flags = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("__l"), F.col("quality").cast("int").alias("q"))
    flags = flags.where((F.col("q") == 0) | ((F.col("q") == 1) & left_out("__l"))).distinct()
    met = scored.where("not base_failed and score is not null").join(flags, F.col("doc_id") == F.col("__l"))
    held = F.greatest(F.least("score", F.lit(SCORE_LIMIT)), F.lit(-SCORE_LIMIT))
    bins = met.groupBy(F.floor(held / STEP).alias("bin")).agg(F.sum("q").alias("good"), F.sum(1 - F.col("q")).alias("bad"))
    return best_cut([(r["bin"], r["good"], r["bad"]) for r in bins.collect()])


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA) -> DataFrame:
    """``cell, w``: ln p_target - ln p_raw of every cell seen in the corpus.

    The raw multinomial counts every document; the target one those in ``trusted``.
    """
    flag = trusted.select(F.col("doc_id").alias("__t"), F.lit(1).alias("good"))
    cells = with_words(docs).select("doc_id", "w").join(F.broadcast(flag), F.col("doc_id") == F.col("__t"), "left")
    cells = cells.select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(ngram_cells(F.col("w"), buckets)).alias("cell"))
    counts = cells.groupBy("cell").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    counts = common.written(counts, "quality-cells")
    tot = counts.agg(F.sum("raw").alias("r"), F.sum("target").alias("t")).first()
    raw_total, target_total = float(tot["r"] or 0), float(tot["t"] or 0)
    if not target_total:
        return counts.select("cell", F.lit(0.0).alias("w"))
    p = lambda c, total: F.log((F.col(c) + F.lit(alpha)) / F.lit(total + alpha * buckets))
    return counts.select("cell", (p("target", target_total) - p("raw", raw_total)).alias("w"))


def quality(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    ``score`` is rounded to 6 places before it is compared, so the verdict does not
    depend on the order in which a sum was taken. Parameters as in :func:`judged`.
    """
    return judged(docs, labels, **params).drop("tid")


def judged(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float | None = THRESHOLD,
    buckets: int = BUCKETS,
    max_target: int = MAX_TARGET,
    alpha: float = ALPHA,
) -> DataFrame:
    """The rows of :func:`quality` with ``tid``, a hash of the text (it tells rows with one doc_id apart)."""
    common.prepare(docs.sparkSession)
    taught = labels if threshold is not None else labels.where(~left_out())
    weights = fit_ratio(docs, trusted_ids(taught, max_target), buckets, alpha)
    weights = common.written(weights, "quality-weights")
    base = base_columns()
    rows = with_words(docs).select(
        "rid", "doc_id", F.xxhash64("text").alias("tid"), *[c.alias(n) for n, c in base.items()], window_hashes(F.col("w"), 3).alias("h"), ngram_cells(F.col("w"), buckets).alias("c")
    )
    # each step has its own projection: an array that a lambda reads must be a column, not an expression
    pairs = F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    again = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.withColumn("ordered", F.when(again, F.sort_array(pairs)).otherwise(F.array().cast("array<struct<h: bigint, i: int>>")))
    rows = rows.withColumn("at", repeated_positions("ordered"))
    numbers = ["doc_id", "tid", *base, "n_repeat_words"]
    rows = rows.select("rid", "doc_id", "tid", *base, covered("at", 3).alias("n_repeat_words"), "c")
    rows = rows.select("rid", *numbers, F.explode_outer("c").alias("cell"))
    # a text's n-grams are summed in the task that split it: one row per document is shuffled
    rows = rows.join(F.broadcast(weights), "cell", "left").groupBy("rid").agg(*[F.max(n).alias(n) for n in numbers], F.avg("w").alias("score"))
    rows = rows.select(*numbers, F.round("score", 6).alias("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    if threshold is None:
        rows = common.written(rows, "quality-scores")
        threshold = calibrated(rows, labels)
    return rows.withColumn(
        "kept", F.coalesce(~F.col("base_failed") & (F.col("score") >= F.lit(threshold)), F.lit(False))
    )


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that pass; all columns are kept."""
    good = judged(docs, labels, **params).where("kept").select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid")).distinct()
    tid = F.xxhash64(common.text_or_empty(F.col("text")))
    return docs.join(good, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (tid == F.col("__tid")), "left_semi")
