"""SentencePiece merge-type encoding and decoding through a prefix table.

A merge encoding leaves every prefix of a text with one last token. Tasks fill, from left to
right, a table of that token per prefix: an automaton over the pieces reports the pieces that
end there, and a piece is the last token exactly if it is *compatible* with the last token of
the prefix before it, i.e. if merging the two pieces' characters gives just these two. The
ids are then read off backwards from the end. No merge queue over the text is needed, and the
work is linear in its length.

Compatibility is decided from the pieces alone. While a piece is built from its characters, only
its right edge (left piece) or left edge (right piece) can take part in a merge across the
border; the merges inside both pieces happen by falling score, so one walk over the two
histories shows whether a merge across the border ever comes first.

Where no piece holds two neighbouring characters, no merge crosses. Texts are cut at such places
(before a space mark, round characters that stand alone) into stretches, and a task keeps the
results of short ones, ``TASK_STRETCHES`` at most. Nothing is shuffled and nothing but the model
(a fixed file) is broadcast.

Defined results: null text is empty text: the end id alone, decoded empty. Characters without a
piece become their UTF-8 bytes' ids. Ids decoded from bytes that are no UTF-8 give U+FFFD for each bad byte.
Very long texts cost a few words of memory per character of their longest stretch.
Repeated rows are returned as often as they come; other columns are ignored; no rows, no result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Stretches whose ids a task holds at a time, and the longest that is held.
TASK_STRETCHES = 400_000
STRETCH_CHARS = 48
#: Pairs of pieces whose compatibility a task holds at a time.
TASK_PAIRS = 1_000_000

MARK = "▁"  # stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the model file


def default_model() -> str:
    """The public merge-type model file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def merge_history(text: str, score: dict[str, float]) -> list[tuple[float, str, str]]:
    """States of merging a text: (score of the merge that comes next, first symbol, last symbol), the end state's score is None.

    Always the adjacent pair whose joined text scores best is merged, of equal scores the leftmost.
    """
    symbols, out = list(text), []
    while True:
        best, at = None, -1
        for k in range(len(symbols) - 1):
            s = score.get(symbols[k] + symbols[k + 1])
            if s is not None and (best is None or s > best):
                best, at = s, k
        out.append((best, symbols[0], symbols[-1]))
        if best is None:
            return out
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


class Pieces:
    """A merge-type model: prefix-table encoder and id-to-piece decoder."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces
        if trainer.model_type != 2 or not plain or norm.remove_extra_whitespaces or not trainer.byte_fallback:
            raise ValueError("needs a merge-type model with byte fallback and identity normalisation")
        if any(p.type in (USER, UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.end = trainer.eos_id
        self.shown: list[str | int | None] = []  # text, byte value, or None for control pieces
        self.byte_ids = [0] * 256
        ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i, p in enumerate(proto.pieces):
            self.shown.append(p.piece if p.type == NORMAL else None)
            if p.type == NORMAL:
                ids[p.piece], self.score[p.piece] = i, p.score
            elif p.type == BYTE:
                self.shown[i] = int(p.piece[1:-1], 16)
                self.byte_ids[self.shown[i]] = i
            elif p.type == UNKNOWN:
                self.shown[i] = trainer.unk_surface
        # tokens: pieces that merging reproduces, and every character that occurs in a piece
        histories = {p: merge_history(p, self.score) for p in ids}
        tokens = [p for p, h in histories.items() if h[-1][1] == p]
        tokens += sorted({c for p in ids for c in p} - set(tokens))
        self.text = tokens
        self.chars = [len(t) for t in tokens]
        self.history = [histories.get(t) or [(None, t, t)] for t in tokens]
        self.out = [(str(ids[t]), 1) if t in ids else (" ".join(map(str, self._bytes(t))), len(self._bytes(t))) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(tokens):
            self.automaton.add_word(t, k)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        # stretches: characters of longer pieces (with the space marks before them), spaces, single others
        joined = "".join(re.escape(c) for c in sorted({c for p in ids if len(p) > 1 for c in p} - {MARK}))
        # id as text -> piece with its space, for ids that are no bytes
        self.plain = {str(i): p.replace(MARK, " ") for p, i in ids.items()}
        self.stretches = re.compile(f"{MARK}*[{joined}]+|{MARK}+|[^{MARK}]").findall
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("needs pieces with space marks in front only")

    def _bytes(self, text: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in text.encode())

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of both tokens leaves exactly these two tokens."""
        a, b, score = self.history[left], self.history[right], self.score.get
        i = j = 0
        while True:
            p, q = a[i][0], b[j][0]
            across = score(a[i][2] + b[j][1])
            # of equal scores the leftmost pair is merged first
            if across is not None and (p is None or across > p) and (q is None or across >= q):
                return False
            if p is not None and (q is None or p >= q):
                i += 1
            elif q is not None:
                j += 1
            else:
                return True

    def prefix_table(self, text: str) -> list[int]:
        """Last token of every non-empty prefix; -1 where it is a character that is in no piece."""
        last = [-1] * (len(text) + 1)  # last[-1] stands for the empty prefix
        chars, known, size = self.chars, self.fits.get, len(self.text)
        done = -1
        for end, k in self.automaton.iter(text):
            # pieces that end at the same character come longest first; the first compatible one is the only one
            if end == done:
                continue
            before = last[end - chars[k]]
            if before >= 0:
                ok = known(before * size + k)
                if ok is None:
                    if len(self.fits) >= TASK_PAIRS:
                        self.fits.clear()
                    ok = self.fits[before * size + k] = self.compatible(before, k)
                if not ok:
                    continue
            last[end] = k
            done = end
        return last

    def tokens(self, text: str) -> list[tuple[str, int]]:
        """(ids as text, number of ids) of a stretch's tokens, recovered from its end backwards."""
        last, out, at = self.prefix_table(text), [], len(text) - 1
        chars, shown = self.chars, self.out
        while at >= 0:
            k = last[at]
            if k < 0:
                ids = self._bytes(text[at])
                out.append((" ".join(map(str, ids)), len(ids)))
                at -= 1
            else:
                out.append(shown[k])
                at -= chars[k]
        out.reverse()
        return out

    def encode_stretch(self, text: str) -> list[int]:
        """Ids of a stretch (space marks already in place)."""
        return [int(i) for ids, _ in self.tokens(text) for i in ids.split()]

    def split(self, text: str) -> list[str]:
        """Stretches of a text that no merge leaves."""
        return self.stretches(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: pieces joined, bytes read as UTF-8, the first piece without its leading space."""
        return self.decode_all(ids, first=True)

    def decode_all(self, ids: Iterable[int], first: bool = False) -> str:
        """As ``decode``; the leading space is only cut if these are the first ids of a text."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            piece = self.shown[i]
            if isinstance(piece, int):
                held.append(piece)
                first = False
                continue
            if held:
                out.append(utf8(held))
                held.clear()
            if piece is not None:
                out.append(piece[1:] if first and piece[:1] == MARK else piece)
                first = False
        if held:
            out.append(utf8(held))
        return "".join(out).replace(MARK, " ")


def utf8(data: bytes) -> str:
    """Bytes as text; every byte that is not part of a character is U+FFFD."""
    try:
        return bytes(data).decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(data[at : at + n]).decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


class _Texts:
    """Encodes texts one after another, with the results of short stretches at hand."""

    def __init__(self, model: bytes):
        self.pieces = _pieces(model)
        self.known: dict[str, tuple[int, str, str]] = {}

    def _entry(self, stretch: str) -> tuple[int, str, str]:
        tokens, plain = self.pieces.tokens(stretch), self.pieces.plain
        ids = " ".join([t[0] for t in tokens])
        try:
            decoded = "".join([plain[t[0]] for t in tokens])
        except KeyError:
            # bytes of a character are read together
            decoded = self.pieces.decode_all(map(int, ids.split()))
        return sum([t[1] for t in tokens]), ids, decoded

    def __call__(self, text: str) -> tuple[int, str, str]:
        """Number of ids (end id included), ids as text, decoded text."""
        stretches, known = self.pieces.split(text), self.known
        found = list(map(known.get, stretches))
        if None in found:
            for k, e in enumerate(found):
                if e is None:
                    s = stretches[k]
                    e = found[k] = known.get(s) or self._entry(s)
                    if len(s) <= STRETCH_CHARS and s not in known:
                        if len(known) >= TASK_STRETCHES:
                            known.clear()
                        known[s] = e
        ids = [e[1] for e in found]
        ids.append(str(self.pieces.end))
        return sum([e[0] for e in found]) + 1, " ".join(ids), "".join([e[2] for e in found])[1:]


def _digest_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts(model.value)
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column(1):
                n, ids, decoded = texts(text.as_py() or "")
                out[0].append(n)
                out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
            cols = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _full_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts(model.value)
        for batch in batches:
            # one text a batch: results of very long texts are not held together
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                _, ids, decoded = texts(text.as_py() or "")
                cols = [pa.array([doc_id.as_py()], pa.int64()), pa.array([[int(i) for i in ids.split()]], pa.list_(pa.int32())), pa.array([decoded], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"])

    return run


def _decode_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value)
        for batch in batches:
            texts = [pieces.decode([i for i in ids or [] if i is not None and 0 <= i < len(pieces.shown)]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _inputs(docs: DataFrame, model: str | None):
    common.prepare(docs.sparkSession)
    with open(model or default_model(), "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), data


def encode_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    texts, data = _inputs(docs, model)
    return texts.mapInArrow(_digest_rows(data), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids (end id last), decoded."""
    texts, data = _inputs(docs, model)
    return texts.mapInArrow(_full_rows(data), "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids and ids outside the model are left out, null lists give empty text."""
    common.prepare(encoded.sparkSession)
    with open(model or default_model(), "rb") as f:
        data = encoded.sparkSession.sparkContext.broadcast(f.read())
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode_rows(data), "doc_id long, text string")
