"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts elsewhere.

1. Segments. Every window (``length`` bytes from one start) is given to one anchor: the
   least hash of a ``GRAM``-byte string in the window. Equal windows have equal anchors at equal
   offsets, so a window can only repeat at another occurrence of its anchor's bytes. The
   consecutive starts of one anchor and the bytes that they need form a *segment*, and each window
   lies in exactly one segment.
2. Segments are grouped by (anchor hash, 128-bit hash of the segment) before the shuffle. A
   segment that occurs more than once repeats whole. Segments that share an anchor with a
   different segment, or hold their anchor's bytes twice, go on; all others hold no repeat.
3. Shards. One copy of each such segment goes to a shard by its anchor; an anchor with more than
   ``anchor_segments`` segments or ``anchor_bytes`` bytes is cut over several shards. A shard sorts its suffixes by
   Larsson-Sadakane refinement (ranks are doubled; only groups that are not yet singletons
   are sorted again) and takes common prefixes with Kasai's recurrence, run over all
   segments in step. Neighbours with a common prefix of ``length`` bytes are repeats.
   Shards of one anchor are merged by binary search: their windows' 128-bit hashes are dealt
   by range, and each shard's sorted windows are looked up in those of the others.
4. Repeated starts of segments go back to the documents, which drop the bytes they cover.

Scale: anchors are about ``2 / (length - GRAM)`` of the bytes; texts move twice, once for the
segments wanted and once for the cuts. A task holds one shard at a time.

A very long periodic text keeps one anchor: its segment is cut into pieces of ``SEGMENT_STARTS`` windows.

Defined results: null text is empty; texts shorter than ``length`` are kept; matches never
cross documents; strings are judged on the input; repeated rows repeat each other; a null
doc_id is an id like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .ngram_join import mix

LENGTH = 400
GRAM = 48
#: Bytes of segments that are sorted together.
SHARD_BYTES = 2 << 20
#: Segments of one anchor in a shard, and their bytes; further ones go to further shards.
ANCHOR_SEGMENTS = 1000
ANCHOR_BYTES = SHARD_BYTES // 2
#: Windows in a segment; a longer one is cut into pieces that overlap by the length less one.
SEGMENT_STARTS = 4096

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(n, np.uint64)
        done = 1
        while done < n:
            step = min(done, n - done)
            p[done : done + step] = p[:step] * _U(pow(b, done, 1 << 64))
            done += step
        out.append(p)
    return out[0], out[1]


class Rolling:
    """Hashes of all windows of a byte string; powers are kept between calls."""

    def __init__(self):
        self.up, self.down = _powers(1 << 16)

    def windows(self, data: np.ndarray, width: int) -> np.ndarray:
        if len(data) >= len(self.up):
            self.up, self.down = _powers(2 * len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * self.up[: len(data)], out=total[1:])
        n = len(data) - width + 1
        return mix((total[width:] - total[:n]) * self.down[:n])


def segments(data: np.ndarray, length: int, gram: int, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """(anchor hash, first start, last start, anchor twice?) of the segments of a text."""
    starts = len(data) - length + 1
    if starts < 1:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    h = rolling.windows(data, gram)
    width = length - gram + 1  # grams in a window
    # least gram hash of each window: running minima from both ends of blocks of that width
    blocks = np.concatenate([h, np.full(-len(h) % width, ~_U(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
    new = np.r_[True, least[1:] != least[:-1]]
    # a periodic text repeats its anchor: pieces of SEGMENT_STARTS windows, counted from the segment's start
    since = np.arange(starts) - np.maximum.accumulate(np.where(new, np.arange(starts), 0))
    first = np.flatnonzero(since % SEGMENT_STARTS == 0)
    last = np.r_[first[1:], starts] - 1
    anchor = least[first]
    twice = np.array([np.count_nonzero(h[a : b + width] == x) > 1 for a, b, x in zip(first.tolist(), last.tolist(), anchor)], bool)
    return anchor, first, last, twice


_SEGMENT_SCHEMA = "anchor long, s1 long, s2 long, first int, last int, twice boolean, doc_id long, tid long"


def _segment_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            anchors, firsts, lasts, twices, hashes, doc, tid = [], [], [], [], [], [], []
            for doc_id, text_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                anchor, first, last, twice = segments(np.frombuffer(raw, np.uint8), length, gram, rolling)
                hashes += [xxhash.xxh3_128_digest(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist())]
                anchors.append(anchor.view(np.int64))
                firsts.append(first)
                lasts.append(last)
                twices.append(twice)
                doc += [doc_id] * len(first)
                tid += [text_id] * len(first)
            if not hashes:
                continue
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(anchors)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.concatenate(firsts).astype(np.int32)),
                 pa.array(np.concatenate(lasts).astype(np.int32)), pa.array(np.concatenate(twices)), pa.array(doc, pa.int64()), pa.array(tid, pa.int64())],
                names=["anchor", "s1", "s2", "first", "last", "twice", "doc_id", "tid"],
            )

    return run


#: Bytes of segments that are handed on together.
CUT_BYTES = 8 << 20


def _cut_out(length: int):
    """Bytes of the wanted segments of each text."""
    types = {"bytes": pa.binary(), "n": pa.int32()}

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in rows.items()], names=list(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = lambda: {"anchor": [], "shards": [], "s1": [], "s2": [], "n": [], "bytes": []}
        rows, size = empty(), 0
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for w in wanted.as_py():
                    for k in ("anchor", "shards", "s1", "s2"):
                        rows[k].append(w[k])
                    rows["n"].append(w["last"] - w["first"] + 1)
                    rows["bytes"].append(raw[w["first"] : w["last"] + length])
                    size += len(rows["bytes"][-1])
                    if size >= CUT_BYTES:
                        yield batch_of(rows)
                        rows, size = empty(), 0
        yield batch_of(rows)

    return run


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros behind the end), in the bytes' order."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(len(data), np.uint64)
    for i in range(8):
        key = (key << _U(8)) | padded[i : len(data) + i].astype(np.uint64)
    return key


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of a byte string.

    Larsson-Sadakane: positions are sorted by their first eight bytes; while groups of equal
    rank remain, the members of each are sorted by the rank h places further on, and h doubles.
    Positions whose group has one member are settled and never sorted again.
    """
    n = len(data)
    key = eight_bytes(data)
    sa = np.argsort(key)  # members of a group may stand in any order
    key = key[sa]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    sizes = np.diff(np.r_[np.flatnonzero(new), n])
    rank[sa] = np.repeat(np.flatnonzero(new), sizes)
    open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
    h = 8
    while len(open_):
        # members of open groups, in suffix array order; a suffix that ends sorts first
        pos = sa[open_]
        ahead = pos + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], n - 1 - pos - n)
        key = rank[pos] * (2 * n + 2) + second + n + 1
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        sa[open_] = pos
        new = np.r_[True, key[1:] != key[:-1]]
        sizes = np.diff(np.r_[np.flatnonzero(new), len(pos)])
        rank[pos] = np.repeat(open_[new], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa


def kasai(data: np.ndarray, sa: np.ndarray, seg_start: np.ndarray, seg_len: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix (by position) with its predecessor in ``sa``, capped at ``length``.

    Kasai's recurrence (the prefix of the next position is at most one shorter) runs over the
    segments in step: step t handles place t of every segment that is long enough.
    """
    n = len(data)
    eight = eight_bytes(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    lcp = np.zeros(n, np.int32)
    carry = np.zeros(len(seg_start), np.int64)
    # longest segments first: those that are long enough for a step are a prefix
    by_size = np.argsort(-seg_len, kind="stable")
    seg_start, sizes = seg_start[by_size], seg_len[by_size]
    for t in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -t, side="left"))
        pos = seg_start[:m] + t
        prev = before[pos]
        h = np.maximum(carry[:m] - 1, 0)
        h[prev < 0] = 0
        go = np.flatnonzero((prev >= 0) & (h < length))
        while len(go):
            a, b = pos[go] + h[go], prev[go] + h[go]
            inside = (a < n) & (b < n)
            if not inside.all():
                go, a, b = go[inside], a[inside], b[inside]
            differ = eight[a] ^ eight[b]
            same = differ == 0
            # bytes in common before the first that differs; places behind the end hold zeros but stop at the end
            first = np.where(same, 8, (differ.byteswap().view(np.uint8).reshape(-1, 8) != 0).argmax(1))
            h[go] += np.minimum(first, n - np.maximum(a, b))
            go = go[same]
            go = go[h[go] < length]
        np.minimum(h, length, out=h)
        lcp[pos] = h
        carry[:m] = h
    return lcp


def repeats_in(parts: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """For every segment: which of its starts have a window that starts again in this shard."""
    sizes = np.array([len(p) for p in parts], np.int64)
    # segments are ended by byte 0 and texts shifted by one (UTF-8 has no byte 255); a window that counts holds no end
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.zeros(at[-1], np.uint8)
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    inside = np.ones(len(data), bool)
    inside[at[1:] - 1] = False
    data[inside] = np.frombuffer(b"".join(parts), np.uint8) + np.uint8(1)
    sa = suffix_array(data)
    lcp = kasai(data, sa, at[:-1], sizes + 1, length)
    # only starts that belong to their segment count; the others are windows of a neighbouring segment
    counts = (np.arange(len(data)) - at[owner]) < np.array(starts, np.int64)[owner]
    run = np.cumsum(lcp[sa] < length)
    sums = np.bincount(run, weights=counts[sa])
    hit = np.zeros(len(data), bool)
    hit[sa] = (sums[run] > 1) & counts[sa]
    return [hit[a : a + n] for a, n in zip(at[:-1], starts)]


def _runs(hit: np.ndarray) -> list[int]:
    """Edges (first, end, first, end, ...) of the runs of true values."""
    return np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).tolist()


_RUN_SCHEMA = "s1 long, s2 long, runs array<int>"


def _shard_rows(length: int, shard_bytes: int):
    """Rows sorted by shard: the repeated runs of starts of each segment. Small shards are sorted together."""

    def flush(held):
        s1, s2, n, parts = ([x for t in held for x in t[i]] for i in range(4))
        runs = [_runs(hit) for hit in repeats_in(parts, n, length)]
        return pa.RecordBatch.from_arrays([pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=["s1", "s2", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, 0
        for table in common.grouped(batches, "shard"):
            # a row given twice names its segments twice
            _, first = np.unique(np.stack([table.column(c).to_numpy() for c in ("s1", "s2")], 1), axis=0, return_index=True)
            table = table.take(pa.array(np.sort(first)))
            group = [table.column(c).to_pylist() for c in ("s1", "s2", "n", "bytes")]
            own = sum(map(len, group[3]))
            if held and size + own > shard_bytes:
                yield flush(held)
                held, size = [], 0
            held.append(group)
            size += own
        if held:
            yield flush(held)

    return run


def window_keys(part: bytes, n: int, length: int) -> np.ndarray:
    """128-bit hashes of a segment's windows, as two columns."""
    view = memoryview(part)
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[i : i + length]) for i in range(n)]), np.int64).reshape(-1, 2)


def _window_rows(length: int):
    """shard, k1, k2, s1, s2, start of every window of the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, s1, s2, n, part in zip(*(batch.column(c).to_pylist() for c in ("shard", "s1", "s2", "n", "bytes"))):
                keys = window_keys(part, n, length)
                one = lambda x: pa.array(np.full(n, x, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [one(shard), pa.array(keys[:, 0]), pa.array(keys[:, 1]), one(s1), one(s2), pa.array(np.arange(n, dtype=np.int32))],
                    names=["shard", "k1", "k2", "s1", "s2", "start"],
                )

    return run


def found_by_search(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which rows of ``keys`` (two columns) are rows of ``ordered`` (sorted by its columns), by binary search."""
    lo = np.searchsorted(ordered[:, 0], keys[:, 0], side="left")
    hi = np.searchsorted(ordered[:, 0], keys[:, 0], side="right")
    hit = np.zeros(len(keys), bool)
    for step in range(int((hi - lo).max(initial=0))):
        at = np.minimum(lo + step, len(ordered) - 1)
        hit |= (lo + step < hi) & (ordered[at, 1] == keys[:, 1])
    return hit


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of window hashes, sorted by shard: the windows of one shard found in another."""
    shards = [t for t in common.grouped(batches, "shard")]
    keys = [np.stack([t.column(c).to_numpy() for c in ("k1", "k2")], 1) for t in shards]
    # equal windows of a shard stand together: one of them is enough to be found
    once = [k[np.r_[True, (k[1:] != k[:-1]).any(1)]] for k in keys]
    for i, table in enumerate(shards):
        hit = np.zeros(table.num_rows, bool)
        for j, other in enumerate(once):
            if i != j:
                hit |= found_by_search(keys[i], other)
        found = table.filter(pa.array(hit)).combine_chunks()
        for batch in found.to_batches():
            runs = [[x, x + 1] for x in batch.column("start").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("s1"), batch.column("s2"), pa.array(runs, pa.list_(pa.int32()))], names=["s1", "s2", "runs"])


def _apply_rows(length: int):
    """Bytes covered by repeated windows are dropped; runs hold (first start, end of starts) as text places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                spans = merged(sorted((r["a"], r["b"] - 1 + length) for r in runs or ()))
                at, kept = 0, []
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out[0].append(len(raw))
                out[1].append(sum(b - a for a, b in spans))
                out[2].append(len(spans))
                out[3].append(hashlib.sha256(b"".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeated_bytes(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
    anchor_segments: int = ANCHOR_SEGMENTS,
    anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    common.prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tid", F.xxhash64("text"))
    found = common.written(docs.select("doc_id", "tid", "text").mapInArrow(_segment_rows(length, gram), _SEGMENT_SCHEMA), "suffix-segments")

    # a segment's copies are counted, and one of them named, before the shuffle
    place = F.struct("tid", "doc_id", "first", "last", "twice")
    kinds = found.groupBy("anchor", "s1", "s2").agg(F.count("*").alias("copies"), F.min(place).alias("at"))
    kinds = common.written(kinds.select("anchor", "s1", "s2", "copies", "at.*"), "suffix-kinds")
    # anchors with unlike segments, or with a segment that may repeat inside
    shards = F.ceil(F.greatest(F.col("kinds") / anchor_segments, F.col("bytes") / anchor_bytes)).alias("shards")
    size = F.sum(F.col("last").cast("long") - F.col("first") + length).alias("bytes")
    live = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), size, F.max("twice").alias("twice")).where("kinds > 1 or twice").select("anchor", shards)
    live = kinds.join(live, "anchor").select(F.col("tid").alias("t"), F.col("doc_id").alias("d"), F.struct("anchor", "shards", "s1", "s2", "first", "last").alias("w"))
    live = common.written(live, "suffix-live")
    own = (F.col("tid") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))

    def cut(wanted: DataFrame) -> DataFrame:
        met = docs.join(wanted.groupBy("t", "d").agg(F.collect_list("w").alias("wanted")), own).select("text", "wanted")
        met = met.mapInArrow(_cut_out(length), "anchor long, shards long, s1 long, s2 long, n int, bytes binary")
        return met.select(F.xxhash64("anchor", F.pmod("s1", "shards")).alias("shard"), "s1", "s2", "n", "bytes")

    # the shuffle is the direct input of the sort: written files may be split anywhere when they are read
    dealt = cut(live).repartition(parts, "shard").sortWithinPartitions("shard")
    runs = dealt.mapInArrow(_shard_rows(length, shard_bytes), _RUN_SCHEMA)
    several = live.where("w.shards > 1")
    if not several.isEmpty():
        windows = cut(several).mapInArrow(_window_rows(length), "shard long, k1 long, k2 long, s1 long, s2 long, start int")
        windows = windows.repartitionByRange(parts, "k1").sortWithinPartitions("shard", "k1", "k2")
        runs = runs.union(windows.mapInArrow(_merge_rows, _RUN_SCHEMA))
    runs = runs.where(F.size("runs") > 0).groupBy("s1", "s2").agg(F.flatten(F.collect_set("runs")).alias("runs"))
    runs = common.written(runs, "suffix-runs")

    # copies repeat whole; other segments where their shards say so
    whole = kinds.where("copies > 1").select("s1", "s2", F.array(F.lit(0), F.col("last") - F.col("first") + 1).alias("whole"))
    verdict = whole.join(runs, ["s1", "s2"], "full").select("s1", "s2", F.coalesce("whole", "runs").alias("runs"))
    hits = found.select("tid", "doc_id", "first", "s1", "s2").join(verdict, ["s1", "s2"])
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)),
        lambda i: F.struct((F.col("first") + F.get("runs", i)).alias("a"), (F.col("first") + F.get("runs", i + 1)).alias("b")),
    )
    edges = hits.groupBy(F.col("tid").alias("t"), F.col("doc_id").alias("d")).agg(F.flatten(F.collect_list(pairs)).alias("runs"))
    met = docs.join(common.written(edges, "suffix-edges"), own, "left").select("doc_id", "text", "runs")
    return met.mapInArrow(_apply_rows(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
