"""Language ID by multilingual mixture inference.

A document is a bag of n-grams drawn from a mixture of languages. Each language's
n-gram distribution is estimated from labelled documents (hashed letter trigrams of
lower-cased words, add-alpha smoothed). For a document, expectation-maximisation finds the
proportions of the languages; the set of languages is chosen greedily by the likelihood
penalised by ``penalty * ln(n)`` for each language after the first (the one that adds most
is added while the penalised likelihood rises). The prediction is the language with the
largest proportion. The score is that proportion; if one language is chosen alone it is
the posterior of that language among the languages taken singly.

Only ``text`` is used to predict. Training counts are aggregated per (language, cell) in
the tasks before the shuffle; the model is one row of ``cells`` numbers per language, bounded by
``cells`` and the number of languages.

Defined results: null text, or a text without any letter, is ``und`` with score 0; without
any training document all texts are ``und``; ties go to the first language by name;
other columns are ignored; a null doc_id trains like any other (crc32 of the empty string).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CELLS = 1 << 16
ALPHA = 0.5
PENALTY = 2.0
FOLDS, HELD_OUT = 4, 2
_SPACE = ord(" ")


def ngram_cells(text: str, cells: int) -> np.ndarray:
    """Hashed letter trigrams: every other character counts as one space, runs of spaces as one."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    if not len(code):
        return np.empty(0, np.int64)
    known, back = np.unique(code, return_inverse=True)
    letters = np.array([c if chr(c).isalpha() else _SPACE for c in known.tolist()], np.uint32)
    code = np.concatenate([[_SPACE], letters[back], [_SPACE]]).astype(np.uint64)
    blank = code == _SPACE
    code = code[~(blank & np.r_[False, blank[:-1]])]
    if len(code) < 3:
        return np.empty(0, np.int64)
    h = (code[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (code[2:] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(cells)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _train_rows(cells: int):
    """lang, cell, n: one row per language and cell that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    own = counts.setdefault(lang, np.zeros(cells, np.int64))
                    own += np.bincount(ngram_cells(text, cells), minlength=cells)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "cell", "n"]
            )

    return run


def train(docs: DataFrame, cells: int = CELLS, alpha: float = ALPHA) -> tuple[list[str], np.ndarray]:
    """Languages by name and their log-probabilities, a (languages, cells) matrix."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null")
    counted = rows.mapInArrow(_train_rows(cells), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    per_lang = counted.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("c"))
    langs, matrix = [], []
    for row in per_lang.orderBy("lang").toLocalIterator():
        own = np.full(cells, alpha)
        at = np.array([(x["cell"], x["n"]) for x in row["c"]])
        own[at[:, 0]] += at[:, 1]
        langs.append(row["lang"])
        matrix.append(np.log(own / own.sum()).astype(np.float32))
    return langs, np.array(matrix).reshape(len(langs), cells)


def fit_proportions(p: np.ndarray, n: np.ndarray, rounds: int = 30, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """EM for mixture proportions: p (cells, languages) likelihoods up to a factor per cell, n counts."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    if p.shape[1] == 1:
        return share, float(n @ np.log(p[:, 0]))
    total = n.sum()
    for _ in range(rounds):
        joint = p * share
        by = joint.sum(1)
        new = (n / by) @ joint / total
        done = np.abs(new - share).max() < tol
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def infer(logp: np.ndarray, cells: np.ndarray, penalty: float = PENALTY) -> tuple[int, float, list[tuple[int, float]]]:
    """(language, score, [(language, proportion) of the chosen set]) of a document's n-grams."""
    at, n = np.unique(cells, return_counts=True)
    part = logp[:, at].astype(np.float64)  # (languages, cells of the document)
    top = part.max(0)
    p = np.exp(part - top).T
    n = n.astype(np.float64)
    single = n @ np.log(p)
    chosen = [int(np.argmax(single))]
    share, best = np.ones(1), float(single[chosen[0]])
    cost = penalty * math.log(max(2.0, n.sum()))
    while len(chosen) < p.shape[1]:
        # one E-step with a little of each absent language shows how much it can add
        now = p[:, chosen] @ share
        gain = n @ np.log(0.9 * now[:, None] + 0.1 * p)
        gain[chosen] = -np.inf
        tried = [*chosen, int(np.argmax(gain))]
        new_share, value = fit_proportions(p[:, tried], n)
        if value - cost <= best:
            break
        chosen, share, best = tried, new_share, value - cost
    # how surely the leading language explains the text better than the others alone
    order = sorted(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
    lead = chosen[order[0]]
    sure = 1 / np.exp(single - single[lead]).sum() if len(chosen) == 1 else 1.0
    return lead, float(min(1.0, share[order[0]] * sure)), [(chosen[i], float(share[i])) for i in order]


def _predict_rows(model, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = model.value
        for batch in batches:
            held, pred, score, mix = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(fold(doc_id) == HELD_OUT)
                cells = ngram_cells(text, logp.shape[1]) if langs and has_letter(text) else ()
                if not len(cells):
                    pred.append("und")
                    score.append(0.0)
                    mix.append("")
                    continue
                lead, s, parts = infer(logp, cells, penalty)
                pred.append(langs[lead])
                score.append(round(s, 6))
                mix.append(" ".join(f"{langs[i]}:{x:.3f}" for i, x in parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held, pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())],
                names=["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    return run


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (the chosen set with its proportions)."""
    spark = docs.sparkSession
    common.prepare(spark)
    model = spark.sparkContext.broadcast((langs, logp))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict_rows(model, penalty), "doc_id long, held_out boolean, lang_pred string, score double, languages string")


def language_id(docs: DataFrame, cells: int = CELLS, alpha: float = ALPHA, penalty: float = PENALTY) -> DataFrame:
    """Learn from the documents outside the held-out fold, predict every document."""
    common.prepare(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    langs, logp = train(docs.where(F.crc32(key.cast("binary")) % FOLDS != HELD_OUT), cells, alpha)
    return predict(docs, langs, logp, penalty)
