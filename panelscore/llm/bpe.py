"""BPE encoding and decoding through a distinct-word table.

1. Tasks split every text into words (the tokenizer's own normaliser and pre-tokenizer
   rules) and count their distinct words; the counts are summed over the corpus.
2. The word table: each of the most frequent words (``table_words`` at most, the
   bound of what is broadcast) is encoded exactly once, in Spark tasks.
3. Ids are joined back by position: a second pass maps the words of a text, in order,
   to their ids through the broadcast table. A word beyond the table (the rare tail)
   is encoded once per task that meets it.
4. Decoding joins ids to the pieces of the vocabulary (bounded by it) in order.

The tail is not joined through a shuffle: this would move each task's distinct words twice
and every text once, more than the disk allowed for the operator (see README).

Defined results: null text is empty text and gives no ids, the digest of the empty string and
``decoded`` empty; special tokens' strings inside a text are those tokens, as in the
library; other columns are ignored; repeated rows are returned as often as they come.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TABLE_WORDS = 200_000
#: Distinct words that a task holds at a time before it hands its counts on.
TASK_WORDS = 150_000


def default_model() -> str:
    """The public word-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters on which Python, its regex engines and the library agree about case, letters, numbers and white space.
PLAIN = "\t\n\r -~\u00a1-\u012f\u0131-\u017f\u2010-\u2027\u20ac"


def _ranges(category: str) -> str:
    """The plain characters of a Unicode category, as text for a character class."""
    plain = [c for c in map(chr, range(0x2100)) if re.match(f"[{PLAIN}]", c)]
    return "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == category)


class Words:
    """Splits texts into words and encodes single words, by the rules in a tokenizer file's text."""

    def __init__(self, spec: str):
        # a task has one core: the library's own threads would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        conf = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.normalizer = self.tokenizer.normalizer
        self.pre = self.tokenizer.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        # the file's own pattern with its two classes spelt out for plain characters
        pattern = conf["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        pattern = pattern.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}").replace("[^\\s\\p{L}\\p{N}]", f"[^\\s{_ranges('L')}{_ranges('N')}]")
        self.find = re.compile(pattern.replace("\\p{L}", f"[{_ranges('L')}]").replace("\\p{N}", f"[{_ranges('N')}]")).findall
        self.odd = re.compile(f"[^{PLAIN}]").search
        self.marks = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        # the same merges without normaliser and splitting: one word in, its ids out
        self.bare = Tokenizer.from_str(json.dumps({**conf, "normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def split(self, text: str) -> list[str]:
        """Words of a text in order; a special token's string is an element of its own."""
        if self.marks is None or "<|" not in text:
            return self._split(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self._split(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.odd(text) and unicodedata.is_normalized("NFC", text):
            # white space is in no word, so it need not be normalised
            return self.find(text.lower())
        # the library's own splitting gives character offsets into the normalised text
        norm = self.normalizer.normalize_str(text)
        return [norm[a:b] for _, (a, b) in self.pre.pre_tokenize_str(norm)]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        todo = [w for w in words if w not in self.special]
        ids = {w: e.ids for w, e in zip(todo, self.bare.encode_batch_fast(todo, add_special_tokens=False))}
        return [ids[w] if w in ids else [self.special[w]] for w in words]

    def pieces(self) -> list[str]:
        """id -> piece as the library shows it."""
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            out[i] = piece
        return out


@lru_cache(maxsize=2)
def _words(spec: str) -> Words:
    return Words(spec)


def _count_rows(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = _words(spec.value), Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(words.split(text.as_py() or ""))
                if len(counts) > TASK_WORDS:
                    yield from out()
                    counts.clear()
        yield from out()

    return run


def _encode_rows(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(spec.value)
        for batch in batches:
            ids = words.encode(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def word_table(docs: DataFrame, spec, table_words: int = TABLE_WORDS) -> DataFrame:
    """``word, ids`` of the most frequent words: all whose count reaches the least count that keeps the table in bound."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_rows(spec), "word string, n long")
    counted = common.written(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "bpe-words")
    # how many words there are of each count, largest counts first; counts above the bound are one line
    top = 1 << 16
    hist = counted.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count("*").alias("words")).collect()
    left, floor = table_words, top + 1
    for row in sorted(hist, key=lambda r: -r["n"]):
        left -= row["words"]
        if left < 0:
            break
        floor = row["n"]
    return counted.where(F.col("n") >= floor).select("word").mapInArrow(_encode_rows(spec), "word string, ids array<int>")


def _text_rows(spec, table, pieces):
    """(doc_id, number of ids, ids as text, decoded text) of each text; words are joined with their ids in order."""

    def run(batch: pa.RecordBatch, known: dict) -> Iterator[tuple]:
        words, shown = _words(spec.value), pieces.value

        def entry(ids):
            return len(ids), " ".join(map(str, ids)), " ".join([shown[i] for i in ids])

        if not known:
            known.update((w, entry(ids)) for w, ids in table.value.items())
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            split = words.split(text.as_py() or "")
            rest = list({w for w in split if w not in known})
            if rest:
                if len(known) > len(table.value) + TASK_WORDS:
                    # the tail is held in bounded number; the table stays
                    for w in list(known)[len(table.value) :]:
                        del known[w]
                    rest = list({w for w in split if w not in known})
                known.update(zip(rest, map(entry, words.encode(rest))))
            found = [known[w] for w in split]
            # a word may have no ids (a byte without a piece): it leaves no gap
            yield doc_id.as_py(), sum([f[0] for f in found]), " ".join([f[1] for f in found if f[0]]), " ".join([f[2] for f in found if f[0]])

    return run


def _digest_rows(rows):
    def run(batches):
        known: dict = {}
        for batch in batches:
            out = [[], [], [], []]
            for doc_id, n, ids, decoded in rows(batch, known):
                out[0].append(doc_id)
                out[1].append(n)
                out[2].append(hashlib.sha256(ids.encode()).hexdigest())
                out[3].append(hashlib.sha256(decoded.encode()).hexdigest())
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _full_rows(rows):
    def run(batches):
        known: dict = {}
        for batch in batches:
            for doc_id, _, ids, decoded in rows(batch, known):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()), pa.array([[int(i) for i in ids.split()]], pa.list_(pa.int32())), pa.array([decoded], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return run


def _rows(docs: DataFrame, model: str | None, table_words: int):
    spark = docs.sparkSession
    common.prepare(spark)
    with open(model or default_model(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    # bounded by table_words and by the vocabulary
    table = {r["word"]: r["ids"] for r in word_table(docs, spec, table_words).toLocalIterator()}
    shown = _words(spec.value).pieces()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts, _text_rows(spec, spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(shown))


def encode_digests(docs: DataFrame, model: str | None = None, table_words: int = TABLE_WORDS) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    texts, rows = _rows(docs, model, table_words)
    return texts.mapInArrow(_digest_rows(rows), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model: str | None = None, table_words: int = TABLE_WORDS) -> DataFrame:
    """One row per document: doc_id, ids, decoded."""
    texts, rows = _rows(docs, model, table_words)
    return texts.mapInArrow(_full_rows(rows), "doc_id long, ids array<int>, decoded string")
