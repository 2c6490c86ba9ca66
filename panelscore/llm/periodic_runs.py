"""Maximal periodic runs of word sequences by recompression.

Grammar. Word numbers of many texts, parted by numbers that occur once, are compressed level by
level: on even levels every maximal block of one symbol becomes a symbol for (symbol, count), on
odd levels a hash deals symbols into left and right ones and every left-right pair becomes a
symbol. Equal stretches get equal symbols but for a few at their ends, and the levels
shrink geometrically: a run-length grammar of the texts with their parse trees.

Extensions. The longest common extension of two places climbs the levels while their symbols are
equal and both start a parent, takes whole symbols (of blocks the smaller rest at once), and
descends from the first difference: a few steps a level. Extensions to the left use the
mirrored levels. All questions of a batch are answered together in numpy.

Candidates. A run of period q and length l >= max(least, times * q) contains, among places a grid
of step max(least - q, (times - 1) * q) apart, one place i with i + q inside too. So over
all periods a text of n words asks O(n log n) questions (a harmonic sum); those whose words differ end at
once. The two extensions give the run's exact ends; of the periods found for equal ends the
smallest is the run's (any other is its multiple).

Every text is worked on by one task as a whole, in batches of ``BATCH_WORDS`` words (a longer
text is a batch of its own; questions are asked ``BATCH_QUERIES`` at a time); nothing is shuffled.

Defined results: null and blank texts have no words, no run and the digests of the empty string.
Ties for the strongest run go to the smallest start, then the smallest period. Repeated rows are
returned as often as they come; a null id has no decimal digits: its text is never made periodic by the
query. Other columns are ignored; no rows, no result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST, TIMES = 24, 3
BATCH_WORDS = 1 << 18
BATCH_QUERIES = 1 << 19
MAX_LEVELS = 120
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd constant of a multiplicative hash


class Levels:
    """Parse trees of a sequence, level 0 first, read from left to right.

    ``symbols[h]``: symbols of level h; ``sizes[h]``: places of level 0 under each; ``parent[h]``:
    index of the parent on level h + 1; ``child[h]``: index of the first child on level h - 1;
    ``rest[h]``: how many equal symbols follow from here, this one included.
    """

    def __init__(self, symbols, sizes, parent, child):
        self.symbols, self.sizes, self.parent, self.child = symbols, sizes, parent, child
        self.rest = [_rest(s) for s in symbols]

    def mirrored(self) -> Levels:
        """The same trees read from right to left."""
        lengths = [len(s) for s in self.symbols]
        parent = [lengths[h + 1] - 1 - p[::-1] for h, p in enumerate(self.parent)]
        child: list = [None]
        for h in range(1, len(lengths)):
            # first child from the right: one before the next parent's first child from the left
            last = np.append(self.child[h][1:], lengths[h - 1]) - 1
            child.append(lengths[h - 1] - 1 - last[::-1])
        return Levels([s[::-1] for s in self.symbols], [s[::-1] for s in self.sizes], parent, child)


def _rest(s: np.ndarray) -> np.ndarray:
    ends = np.append(np.flatnonzero(s[1:] != s[:-1]), len(s) - 1)
    return np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(s)) + 1


def recompress(seq: np.ndarray) -> Levels:
    """Levels of a non-empty sequence of small whole numbers."""
    symbols, sizes, parents, children = [seq], [np.ones(len(seq), np.int64)], [], [None]
    fresh = int(seq.max()) + 1
    for h in range(MAX_LEVELS):
        s = symbols[-1]
        if len(s) == 1:
            break
        if h % 2 == 0:
            starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            counts = np.diff(starts, append=len(s))
            joined, other = counts > 1, counts
        else:
            # an even or odd bit of a hash of the symbol and the level: left or right
            right = ((s.astype(np.uint64) + np.uint64(h)) * _MIX >> np.uint64(40 + h % 16)) & np.uint64(1) == 1
            pairs = np.flatnonzero(~right[:-1] & right[1:])
            first = np.ones(len(s), bool)
            first[pairs + 1] = False
            starts = np.flatnonzero(first)
            joined = np.zeros(len(s), bool)
            joined[pairs] = True
            joined = joined[starts]
            other = s[np.minimum(starts + 1, len(s) - 1)]
        up = s[starts].copy()
        if joined.any():
            # equal (symbol, count) or (left, right) get equal new numbers
            key = up[joined] * (int(other[joined].max()) + 1) + other[joined]
            names, which = np.unique(key, return_inverse=True)
            up[joined] = fresh + which
            fresh += len(names)
        parent = np.cumsum(np.bincount(starts, minlength=len(s))) - 1
        symbols.append(up)
        sizes.append(np.add.reduceat(sizes[-1], starts))
        parents.append(parent)
        children.append(starts)
    return Levels(symbols, sizes, parents, children)


def extensions(levels: Levels, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common stretch from places ``i`` and ``j`` (``i < j``) of level 0."""
    total = np.zeros(len(i), np.int64)
    top = len(levels.symbols) - 1
    # questions by level, climbing from the bottom; descending ones are picked up on the way down
    who, a, b = np.arange(len(i)), i, j
    fallen: list[list[tuple]] = [[] for _ in range(top + 1)]

    def take(h, who, a, b, n):
        total[who] += n * levels.sizes[h][a]
        return a + n, b + n

    for h in range(top + 1):
        s, size, rest = levels.symbols[h], len(levels.symbols[h]), levels.rest[h]
        climbed = []
        while len(who):
            inside = b < size
            same = inside.copy()
            same[inside] = s[a[inside]] == s[b[inside]]
            fallen[h].append((who[~same], a[~same], b[~same]))
            who, a, b = who[same], a[same], b[same]
            if h < top:
                parent, child = levels.parent[h], levels.child[h + 1]
                pa_, pb = parent[a], parent[b]
                ready = (child[pa_] == a) & (child[pb] == b)
                climbed.append((who[ready], pa_[ready], pb[ready]))
                who, a, b = who[~ready], a[~ready], b[~ready]
            a, b = take(h, who, a, b, np.minimum(rest[a], rest[b])) if len(who) else (a, b)
        if climbed:
            who, a, b = (np.concatenate(x) for x in zip(*climbed))
    for h in range(top, 0, -1):
        if not fallen[h]:
            continue
        # a difference on level h lies under both symbols' first children
        who, a, b = (np.concatenate(x) for x in zip(*fallen[h]))
        size = len(levels.symbols[h])
        inside = (a < size) & (b < size)
        who, a, b = who[inside], levels.child[h][a[inside]], levels.child[h][b[inside]]
        s, size, rest = levels.symbols[h - 1], len(levels.symbols[h - 1]), levels.rest[h - 1]
        while len(who):
            inside = b < size
            same = inside.copy()
            same[inside] = s[a[inside]] == s[b[inside]]
            fallen[h - 1].append((who[~same], a[~same], b[~same]))
            who, a, b = who[same], a[same], b[same]
            a, b = take(h - 1, who, a, b, np.minimum(rest[a], rest[b])) if len(who) else (a, b)
    return total


def candidates(n: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods q of the harmonic grid of a text of ``n`` words, in blocks of ``BATCH_QUERIES`` about."""
    periods = np.arange(1, n // times + 1)
    if n < least or not len(periods):
        return
    step = np.maximum(least - periods, (times - 1) * periods)
    count = (n - 1 - periods) // step + 1
    edges = np.cumsum(count)
    at = 0
    while at < len(periods):
        done = edges[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(edges, done + BATCH_QUERIES, "right")))
        c = count[at:to]
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield k * np.repeat(step[at:to], c), np.repeat(periods[at:to], c)
        at = to


def runs_of(texts: list[list], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Runs of each sequence of hashable words: rows (start, length, period), by start, then period."""
    if least < 2 or times < 2:
        raise ValueError("a run has at least two words and two periods")
    names: dict = {}
    empty = np.zeros((0, 3), np.int64)
    out = [empty] * len(texts)
    coded, at, size = [], {}, 0
    for t, words in enumerate(texts):
        if len(words) >= least:
            at[t] = size
            coded.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)))
            size += len(words) + 1
    if not coded:
        return out
    # a number that occurs once ends each text, so nothing extends across
    seq = np.concatenate([np.append(c, len(names) + k) for k, c in enumerate(coded)])
    levels = None
    found: list[np.ndarray] = []
    grids: dict[int, list] = {}
    held, held_size = [], 0

    def answer():
        nonlocal levels, held, held_size
        i, q = (np.concatenate(x) for x in zip(*held))
        held, held_size = [], 0
        if not len(i):
            return
        if levels is None:
            forward = recompress(seq)
            levels = forward, forward.mirrored()
        right = extensions(levels[0], i, i + q)
        back = extensions(levels[1], len(seq) - i - q, len(seq) - i)
        length = right + back + q
        keep = length >= np.maximum(least, times * q)
        found.append(np.unique(np.stack([i - back, length, q], 1)[keep], axis=0))

    for t, base in at.items():
        n = len(texts[t])
        small = n <= 4096
        blocks = grids.get(n) if small else None
        if blocks is None:
            blocks = candidates(n, least, times)
            if small:
                blocks = grids[n] = list(blocks)
        for i, q in blocks:
            same = np.flatnonzero(seq[base + i] == seq[base + i + q])
            held.append((base + i[same], q[same]))
            held_size += len(same)
            if held_size > BATCH_QUERIES:
                answer()
    if held:
        answer()
    if not any(map(len, found)):
        return out
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # equal ends: the smallest period is the run's
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    starts = np.array(list(at.values()))
    owner = np.searchsorted(starts, rows[:, 0], "right") - 1
    for k, t in enumerate(at):
        mine = rows[np.searchsorted(owner, k) : np.searchsorted(owner, k, "right")].copy()
        mine[:, 0] -= at[t]
        out[t] = mine
    return out


def words(text: str | None) -> list[bytes]:
    """ASCII-white-space words of a text, in UTF-8."""
    return (text or "").encode().split()


def strongest(runs: np.ndarray) -> np.ndarray | None:
    """The run of greatest length over period; ties: smallest start, then period."""
    if not len(runs):
        return None
    return min(runs.tolist(), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def collapsed(seq: list, runs: np.ndarray) -> list:
    """Words left when each run keeps its first period (unless another run drops that too)."""
    if not len(runs):
        return seq
    edge = np.zeros(len(seq) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [seq[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def planted(doc_id: int | None, seq: list) -> list:
    """The contract's input: one text in ten is made periodic from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(seq)
    if h % 10 or not n:
        return seq
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return seq[:a] + [seq[a + k % p] for k in range(n - a)]


def _batched(batches, plant):
    """(ids, texts as word lists) in batches of bounded size."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            seq = words(text.as_py())
            i = doc_id.as_py()
            ids.append(i)
            texts.append(planted(i, seq) if plant else seq)
            size += len(seq)
            if size >= BATCH_WORDS or len(ids) >= 10_000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _digest_rows(least, times, plant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batched(batches, plant):
            cols: list[list] = [[] for _ in range(7)]
            for seq, runs in zip(texts, runs_of(texts, least, times)):
                top = strongest(runs)
                lines = "".join([f"{a},{n},{q}\n" for a, n, q in runs.tolist()])
                row = (len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None)
                row += (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(seq, runs))).hexdigest())
                for c, v in zip(cols, row):
                    c.append(v)
            arrays = [pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in cols[:5]], *[pa.array(c, pa.string()) for c in cols[5:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=DIGESTS.replace(" long", "").replace(" string", "").split(", "))

    return run


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _full_rows(least, times, plant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for ids, texts in _batched(batches, plant):
            spans = runs_of(texts, least, times)
            rows = [[{"start": a, "length": n, "period": q} for a, n, q in r.tolist()] for r in spans]
            left = [b" ".join(collapsed(seq, r)).decode() for seq, r in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, kind), pa.array(left, pa.string())], names=["doc_id", "runs", "text"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    common.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period), text with each run collapsed to its first period."""
    return _texts(docs).mapInArrow(_full_rows(least, times, False), "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")


def run_digests(docs: DataFrame, plant: bool = True) -> DataFrame:
    """One row per document: the columns of ``DIGESTS``, over texts of which one in ten is made periodic (``plant``)."""
    return _texts(docs).mapInArrow(_digest_rows(LEAST, TIMES, plant), DIGESTS)
