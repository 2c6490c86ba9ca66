"""Substring dedup by sliding sentence spans.

A text is cut into sentences: behind ``.``, ``!``, ``?`` and closing quotes or brackets before white
space, behind the full stops of other scripts, and at line breaks. A sentence of more than
``LONG_WORDS`` words (and ``LONG_CHARS`` characters) is cut into pieces where a hash of two neighbouring words says so, so equal
sentences have equal pieces wherever they stand. In scripts without spaces every character counts as a word. From every sentence on, the shortest run of at least ``min_sentences`` sentences
that has at least ``min_words`` words is a span, named by a 128-bit hash of its words. Spans
are joined over the whole corpus: every occurrence of a span but the first (smallest doc_id,
then place in the text) is a repeat, and every sentence covered by a repeat is
removed. What a passage's spans are depends on the passage alone, so a shared passage is
found wherever it stands.

With ``whole`` (as the query runs) the shortest run back from every sentence is a span too, and
a text without such a run is one span as a whole. A sentence of a repeated run either starts
a span inside the run or lies in the span that ends with the run, so what goes is all that
repeated runs of so many sentences and words, of any length, cover. Without it the
last sentences of a run stay where no span that starts there fits into it.

Scale: first occurrences and counts are aggregated before the shuffle, and spans that occur
once are dropped there; the occurrences are joined with the rest on the hashes, a plain
equi-join that Spark splits at hot spans. Texts move once, to meet their own cuts.

Defined results: null text is empty text; texts with fewer sentences or words than a span
are left as they are, with ``whole`` only where no other text is equal; rows with equal doc_id count as one document (none is a repeat of
another); a null doc_id comes after all others; kept sentences keep the white space behind
them; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_SENTENCES = 2
MIN_WORDS = 20

#: Words from which a sentence is cut into pieces; a piece ends behind one pair of words in PIECE_WORDS, at the latest after LONG_WORDS.
LONG_WORDS = 40
PIECE_WORDS = 8
#: Shorter sentences are left whole, however short their words (scripts without spaces: no such bound).
LONG_CHARS = 4 * LONG_WORDS

_CLOSING = "\"'\u201d\u2019\u00bb\u203a)\\]}\u300d\u300f\u3011\uff09"
_END = re.compile(rf"[.!?\u2026]+[{_CLOSING}]*\s+|[\u3002\uff01\uff1f\uff61\uff0e\u061f\u06d4\u0964\u0965]+[{_CLOSING}]*\s*|\n\s*")
# the same rule for texts of Latin characters
_LATIN_END = re.compile(r"[.!?]+[\"'\u00bb)\]}]*\s+|\n\s*")
# scripts written without spaces: Thai, Lao, Burmese, Khmer, kana, Han
_NO_SPACES = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_DENSE = re.compile(f"[{_NO_SPACES}]")
_WORD = re.compile(f"(?:[{_NO_SPACES}]|[^\\s{_NO_SPACES}]+)\\s*")
_SPAN_SCHEMA = "h1 long, h2 long, doc_id long, tid long, at int, upto int, again boolean"


def _pieces(sentence: str) -> Iterator[str]:
    """A long sentence cut where its words say so."""
    ends = [m.end() for m in _WORD.finditer(sentence)]
    if len(ends) <= LONG_WORDS:
        yield sentence
        return
    hashes = [zlib.crc32(sentence[a:b].strip().encode("utf-8", "surrogatepass")) for a, b in zip([0, *ends], ends)]
    at, since = 0, 0
    for k, end in enumerate(ends[:-1]):
        since += 1
        mixed = (hashes[k - 1] * 31 + hashes[k]) * 0x9E3779B1 >> 16 if k else 1
        if since >= LONG_WORDS or (since > 1 and mixed % PIECE_WORDS == 0):
            yield sentence[at:end]
            at, since = end, 0
    yield sentence[at:]


def _plain(text: str) -> bool:
    """Whether a text has Latin characters only (cheap to tell, and then cheaper rules find the same)."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def sentences(text: str) -> list[str]:
    """The sentences (and pieces of long ones) of a text in order, each with the white space behind it: joined they give the text."""
    return _sentences(text, *_kind(text))


def _kind(text: str) -> tuple[bool, bool]:
    """(Latin characters only?, characters of scripts without spaces?)"""
    plain = _plain(text)
    return plain, not plain and _DENSE.search(text) is not None


def _sentences(text: str, plain: bool, dense: bool) -> list[str]:
    find = _LATIN_END if plain else _END
    cuts = [0, *[m.end() for m in find.finditer(text)], len(text)]
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
    least = LONG_WORDS if dense else LONG_CHARS
    if not any([len(p) > least for p in parts]):
        return parts
    return [piece for p in parts for piece in (_pieces(p) if len(p) > least else (p,))]


def spans(text: str, min_sentences: int, min_words: int, whole: bool) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, last sentence, hash) of the spans that start (``whole``: or end) at each sentence, by their starts."""
    plain, dense = _kind(text)
    parts = _sentences(text, plain, dense)
    words = [s.encode("utf-8", "surrogatepass").split() for s in parts]
    sizes = [len(_WORD.findall(s)) for s in parts] if dense else [len(w) for w in words]
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    n = len(words)
    if not sums[-1]:
        return
    joined = [b" ".join(w) for w in words]
    # only the first sentence of a text can be blank; no span starts there
    start = 0 if words[0] else 1
    if n - start < min_sentences or sums[-1] < min_words:
        if whole:
            yield start, n - 1, xxhash.xxh3_128_digest(b"\x00".join(joined[start:]))
        return
    at = np.arange(n)
    # least end (exclusive) from each start, and greatest start for each end, with enough words and sentences
    ends = np.maximum(np.searchsorted(sums, sums[:-1] + min_words), at + min_sentences)
    runs = {(a, e) for a, e in zip(at.tolist(), ends.tolist()) if a >= start and e <= n}
    if whole:
        starts = np.minimum(np.searchsorted(sums, sums[1:] - min_words, side="right") - 1, at + 1 - min_sentences)
        runs |= {(a, e) for a, e in zip(starts.tolist(), (at + 1).tolist()) if a >= start}
    for a, e in sorted(runs):
        yield a, e - 1, xxhash.xxh3_128_digest(b"\x00".join(joined[a:e]))


def _span_rows(min_sentences: int, min_words: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, doc, tid, at, upto, again = [], [], [], [], [], []
            for doc_id, text_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                seen = set()
                for a, b, h in spans(text or "", min_sentences, min_words, whole):
                    hashes.append(h)
                    at.append(a)
                    upto.append(b)
                    again.append(h in seen)
                    seen.add(h)
                n = len(hashes) - len(doc)
                doc += [doc_id] * n
                tid += [text_id] * n
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(doc, pa.int64()), pa.array(tid, pa.int64()),
                 pa.array(at, pa.int32()), pa.array(upto, pa.int32()), pa.array(again, pa.bool_())],
                names=["h1", "h2", "doc_id", "tid", "at", "upto", "again"],
            )

    return run


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, texts = [], [], []
        for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            parts = sentences(text or "")
            covered = np.zeros(len(parts) + 1, np.int64)
            for cut in cuts or ():
                covered[cut["at"]] += 1
                covered[cut["upto"] + 1] -= 1
            keep = np.cumsum(covered[:-1]) == 0
            n.append(len(parts))
            gone.append(int((~keep).sum()))
            texts.append("".join(p for p, k in zip(parts, keep.tolist()) if k))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())],
            names=["doc_id", "n_sentences", "n_removed", "text"],
        )


def remove_repeats(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed, text (without repeated spans)."""
    common.prepare(docs.sparkSession)
    last = F.lit((1 << 63) - 1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("tid", F.xxhash64("text"))
    found = docs.select(F.coalesce("doc_id", last).alias("doc_id"), "tid", "text").mapInArrow(_span_rows(min_sentences, min_words, whole), _SPAN_SCHEMA)
    repeated = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # written, so that the join has shuffles of its own on both sides, which Spark can split at a hot span
    repeated = common.written(repeated, "span-repeated")
    cuts = found.join(repeated, ["h1", "h2"]).where("again or doc_id > first").select("doc_id", "tid", "at", "upto").distinct()
    cuts = cuts.groupBy(F.col("doc_id").alias("d"), F.col("tid").alias("t")).agg(F.collect_list(F.struct("at", "upto")).alias("cuts"))
    cuts = common.written(cuts, "span-cuts")
    met = docs.join(cuts, (F.coalesce("doc_id", last) == F.col("d")) & (F.col("tid") == F.col("t")), "left")
    return met.select("doc_id", "text", "cuts").mapInArrow(_cut_rows, "doc_id long, n_sentences long, n_removed long, text string")
