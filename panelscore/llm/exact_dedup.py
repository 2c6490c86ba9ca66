"""Exact dedup with an extendible-hash index kept as files on the shared folder.

1. Every input task normalises its texts, drops its own repeats (bytes compared)
   and keeps one *local representative* per distinct text; the row -> local
   representative map and the representatives' texts are written once.
2. The directory: distinct 64-bit keys are counted by their leading bits, and the
   directory is doubled (global depth + 1) while a bucket holds more keys than
   ``bucket_keys``; a bucket that fits keeps its shorter local depth. Keys whose
   leading bits agree up to ``max_depth`` stay in one bucket and chain there.
3. Owner tasks, as many as the texts' bytes ask for, each process key ranges (whole buckets), sorted by key. Rows with
   one key form a chain; a chain entry is a distinct text, found by comparing
   bytes, so two texts that collide on a key stay apart. Owners write the index:
   files of (bucket, key, local representative, chain entry, digest).
4. Sizes and smallest ids are aggregated per chain entry; rows look up their local
   representative in the index.

A group of copies costs one row per input task in its owner, never one per copy.

Defined results: null text equals empty text; a null ``doc_id`` is larger than any
other; of rows equal in text and doc_id, one stays (``kept``); extra columns are
carried untouched by :func:`exact_dedup` as long as they exist; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: White space of the contract, for the JVM.
WHITE_SPACE = r"[ \t\n\x0B\f\r]+"
MAX_DEPTH = 20
#: Bytes of texts that a task holds while it looks for its own repeats; then it starts anew.
LOCAL_BYTES = 48 << 20

#: Bytes of texts that an owner task is to read.
OWNER_BYTES = 64 << 20

_MAP_SCHEMA = "rid long, doc_id long, rep long, key long, size long, text binary"
_CHAIN_SCHEMA = "bucket long, key long, rep long, chain int, sha binary"


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with every run of ASCII white space replaced by one space."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = b" ".join(data.split())
    if data and data[:1] in b" \t\n\x0b\x0c\r":
        out = b" " + out
    if data and out != b" " and data[-1:] in b" \t\n\x0b\x0c\r":
        out += b" "
    return out


def _key(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def _map_rows(local_bytes: int, key_fn=_key):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        n, held, size = 0, {}, 0
        for batch in batches:
            out = {k: [] for k in ("rid", "doc_id", "rep", "key", "size", "text")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = normalise(text)
                rid = base + n
                n += 1
                rep = held.get(data)
                out["rid"].append(rid)
                out["doc_id"].append(doc_id)
                if rep is None:
                    if size > local_bytes:
                        held, size = {}, 0
                    rep = held[data] = rid
                    size += len(data) + 100
                    out["text"].append(data)
                else:
                    out["text"].append(None)
                out["rep"].append(rep)
                out["key"].append(key_fn(data))
                out["size"].append(len(data))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[k], pa.binary() if k == "text" else pa.int64()) for k in out], names=list(out)
            )

    return run


def build_directory(counts: list[tuple[int, int]], depth: int, bucket_keys: int) -> list[tuple[int, int]]:
    """(prefix of ``depth`` bits, bucket) for every prefix, from the key count of each prefix.

    Starts with one bucket of local depth 0 and splits overfull buckets by their next
    bit until each fits or has reached the global depth.
    """
    by = dict(counts)
    total = [0] * ((1 << depth) + 1)
    for p in range(1 << depth):
        total[p + 1] = total[p] + by.get(p, 0)
    directory, todo, bucket = [], [(0, 0)], 0
    while todo:
        prefix, d = todo.pop()
        lo, hi = prefix << (depth - d), (prefix + 1) << (depth - d)
        if total[hi] - total[lo] > bucket_keys and d < depth:
            todo += [(2 * prefix + 1, d + 1), (2 * prefix, d + 1)]
        else:
            directory += [(p, bucket) for p in range(lo, hi)]
            bucket += 1
    return directory


def _prefix(depth: int):
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def _directory(keys: DataFrame, bucket_keys: int | None, max_depth: int, buckets: int) -> tuple[int, list[tuple[int, int]]]:
    """Global depth and directory; the directory is doubled while a bucket is overfull and bits are left.

    Only key counts by prefix reach the driver, at most ``2 ** depth`` of them.
    """
    keys, depth = common.written(keys, "dedup-keys"), 0
    while True:
        counts = [(r["p"], r["n"]) for r in keys.groupBy(_prefix(depth).alias("p")).agg(F.count("*").alias("n")).collect()]
        if bucket_keys is None:
            bucket_keys = max(256, sum(n for _, n in counts) // buckets)
        worst = max((n for _, n in counts), default=0)
        if worst <= bucket_keys or depth >= max_depth:
            return depth, build_directory(counts, depth, bucket_keys)
        # one doubling for each halving that the largest bucket still needs
        depth = min(max_depth, depth + max(1, (worst // bucket_keys).bit_length()))


def _owner_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per local representative with its chain entry, found by comparing bytes.

    Rows arrive sorted by key; only the texts of one key are held.
    """
    key, entries = None, []
    for batch in batches:
        chain, sha = [], []
        for k, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if k != key:
                key, entries = k, []
            at = next((i for i, e in enumerate(entries) if e[0] == data), None)
            if at is None:
                at = len(entries)
                entries.append((data, hashlib.sha256(data).digest()))
            chain.append(at)
            sha.append(entries[at][1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(chain, pa.int32()), pa.array(sha, pa.binary())],
            names=["bucket", "key", "rep", "chain", "sha"],
        )


def build_index(
    docs: DataFrame, bucket_keys: int | None = None, max_depth: int = MAX_DEPTH, local_bytes: int = LOCAL_BYTES, key_fn=_key, owner_bytes: int = OWNER_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(row map, index): ``rid, doc_id, rep`` per row, and one index row per local representative.

    There are as many owner tasks as hold ``owner_bytes`` of texts each, and no fewer than shuffle partitions;
    ``bucket_keys`` defaults to a quarter of an owner task's even share of the keys.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = common.written(src.mapInArrow(_map_rows(local_bytes, key_fn), _MAP_SCHEMA), "dedup-rows")
    reps = rows.where(F.col("text").isNotNull()).select("key", "rep", "text")
    volume = rows.where(F.col("rid") == F.col("rep")).agg(F.sum("size").alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // owner_bytes))
    depth, directory = _directory(reps.select("key").distinct(), bucket_keys, max_depth, 4 * parts)
    # at most 2 ** max_depth entries of two numbers: a bounded broadcast, so texts move once
    table = F.broadcast(spark.createDataFrame(directory, "prefix long, bucket long"))
    owned = reps.withColumn("prefix", _prefix(depth)).join(table, "prefix").select("bucket", "key", "rep", "text")
    owned = owned.repartition(parts, "bucket").sortWithinPartitions("bucket", "key")
    chains = common.written(owned.mapInArrow(_owner_rows, _CHAIN_SCHEMA), "dedup-index")
    first = F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "rid")
    local = rows.groupBy("rep").agg(F.min(first).alias("f"), F.count("*").alias("n"))
    members = chains.join(local, "rep")
    entries = members.groupBy("key", "chain").agg(F.min("f").alias("f"), F.sum("n").alias("group_size"))
    index = members.select("rep", "key", "chain", "sha").join(entries, ["key", "chain"])
    index = index.select("rep", "chain", "group_size", "sha", F.col("f.doc_id").alias("keep_id"), F.col("f.rid").alias("keep_rid"))
    return rows.select("rid", "doc_id", "rep"), index


def dedup_rows(docs: DataFrame, **params) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, chain (entry within its key)."""
    rows, index = build_index(docs, **params)
    return rows.join(index, "rep").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "chain",
    )


def exact_dedup(docs: DataFrame, **params) -> DataFrame:
    """``docs`` without exact copies: of equal texts the row with the smallest doc_id stays, with all its columns."""
    keep = dedup_rows(docs, **params).where("kept").select(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"))
    tagged = docs.withColumn("__sha", F.sha2(F.regexp_replace(common.text_or_empty(F.col("text")), WHITE_SPACE, " "), 256))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__keep_id")) & (F.col("__sha") == F.col("__keep_sha"))
    kept = tagged.join(keep, same, "left_semi")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "__sha"])
    return kept.drop("__sha")
