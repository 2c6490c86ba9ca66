"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets
link when ``100 * |x & y| >= pct * |x | y|``. Links are found without emitting
pairs of a group:

1. Equal sets are one *class* (size, 64-bit digest of the sorted set); later steps
   handle classes only.
2. Candidate bands. Linked sets differ in at most ``D = |x| + |y| - 2o`` shingles,
   ``o`` being the least overlap that links. Sizes are cut into bands [2^b, 2^(b+1));
   in a band's family the hash space is cut into K parts, K above every D of the
   family. At least K - D parts of two linked sets are equal, so if each set omits
   only its K - D - 1 lightest parts, an equal part is named by both: a set names its
   D + 1 heaviest parts by (family, part, digest of the part's shingles). A set that
   can be the larger partner of the band below joins that family too.
   No link is lost, and a passage shared by unlike documents names no common part.
3. Classes that share a name are chained (rows sorted by name, each to the first of
   its name); connected components of the chains are the *clusters*. All links lie
   inside clusters.
4. Tiles. Members of a cluster are cut into blocks by size band and, beyond
   ``tile_rows`` members, by hash; a tile is a pair of blocks whose sizes can link.
   In a tile a hashed bitmap of every set (a bit flips with each shingle that hashes to
   it) bounds the overlap from above, since the set bits of x ^ y are at most
   the shingles in which x and y differ; every pair that passes is intersected
   exactly. Every pair of a cluster's classes meets in one tile, so each link is found
   once: :func:`class_links` returns them. For :func:`jaccard_components` a tile counts
   them, one row per class (weighted by class sizes, so copies are counted without being
   expanded), beside a spanning forest, so a group of near copies costs no row per pair.
5. Connected components of those links and the sums of those counts give the answer.

Defined results: null and blank texts have an empty set and are linked with nothing;
a text with fewer words than a shingle is one shingle; equal non-empty sets link; a null
doc_id is linked like others and never is a component's smallest id unless all its ids are
null; repeated rows are returned as often as they come; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_U = np.uint64
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
#: Members of a block; a tile holds two blocks.
TILE_ROWS = 1000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit reaches every output bit)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(33)
    x *= _M1
    x ^= x >> _U(33)
    x *= _M2
    x ^= x >> _U(33)
    return x


def with_shingles(docs: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``set``, the sorted distinct shingle hashes of ``text`` (words lower-cased A-Z)."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(*keep, common.words_of(lower).alias("__w"))
    idx = F.sequence(F.lit(0), F.size("__w") - k)
    many = F.transform(idx, lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(k)]))
    few = F.array(F.xxhash64(F.lit("short"), "__w"))
    none = F.array().cast("array<bigint>")
    hashes = F.when(F.size("__w") >= k, many).when(F.size("__w") > 0, few).otherwise(none)
    return rows.select(*keep, F.array_sort(F.array_distinct(hashes)).alias("set"))


def max_difference(n: int, pct: int, larger: bool) -> int:
    """The most shingles by which a set of size n and a linked one can differ (n the larger, or the smaller)."""
    # with sizes n >= m and overlap o <= m: o >= pct (n + m) / (100 + pct), so the difference is
    # n + m - 2o <= (n + m)(100 - pct) / (100 + pct), and m >= pct n / 100
    total = 2 * n if larger else n + 100 * n // pct
    return total * (100 - pct) // (100 + pct)


def families(n: int, pct: int) -> list[tuple[int, int, int]]:
    """(family, parts K, names to give) of a set of size n."""
    band = n.bit_length() - 1
    parts = lambda b: int(1.25 * max_difference((2 << b) - 1, pct, False)) + 1
    out = [(band, parts(band), max_difference(n, pct, False) + 1)]
    if band and -(-pct * n // 100) < 1 << band:
        out.append((band - 1, parts(band - 1), max_difference(n, pct, True) + 1))
    return out


def digest(values: np.ndarray) -> int:
    """Order-free 64-bit digest of a set of hashes."""
    m = mix(values.view(np.uint64))
    total = mix(np.array([m.sum(dtype=np.uint64) + _U(len(m))])) ^ np.bitwise_xor.reduce(m)
    return int(total.view(np.int64)[0])


def names(values: np.ndarray, pct: int) -> np.ndarray:
    """The names a set gives (see the module's step 2), as int64."""
    out = []
    h = mix(values.view(np.uint64))
    content = mix(h + _U(0x9E3779B97F4A7C15))
    for family, k, give in families(len(values), pct):
        part = ((h >> _U(32)) * _U(k)) >> _U(32)
        part = part.astype(np.int64)
        weight = np.bincount(part, minlength=k)
        total = np.zeros(k, np.uint64)
        np.add.at(total, part, content)
        name = mix(total + mix(np.arange(k, dtype=np.uint64) + _U((family + 1) << 32)))
        # heaviest first; equal weights in the order of their names, which equal parts share
        order = np.lexsort((name, -weight))[:give]
        out.append(name[order])
    return np.concatenate(out).view(np.int64)


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield values[a:b]


def _name_rows(pct: int):
    """doc_id, tid, n, cls of each document; and, once per class and task, the class's names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cls, given = [], []
            for values in _arrays(batch.column(2)):
                if not len(values):
                    cls.append(None)
                    given.append(None)
                    continue
                c = digest(values)
                cls.append(c)
                given.append(None if c in seen else names(values, pct))
                seen.add(c)
                if len(seen) > 1_000_000:
                    seen.clear()
            size = pc.list_value_length(batch.column(2)).cast(pa.int64())
            arrays = [batch.column(0), batch.column(1), size, pa.array(cls, pa.int64()), pa.array(given, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tid", "n", "cls", "names"])

    return run


def _own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (class, set) whose set has the class's digest."""
    for batch in batches:
        own = [c == digest(v) for c, v in zip(batch.column(0).to_pylist(), _arrays(batch.column(1)))]
        yield batch.filter(pa.array(own, pa.bool_()))


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (name, class): an edge from every further class of a name to its first one."""
    name, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        names_, classes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        start = np.r_[name is None or names_[0] != name, names_[1:] != names_[:-1]]
        at = np.maximum.accumulate(np.where(start, np.arange(len(start)), -1))
        head = np.where(at >= 0, classes[at], first if first is not None else 0)
        edge = classes != head
        name, first = names_[-1], head[-1]
        if edge.any():
            pairs = np.unique(np.stack([head[edge], classes[edge]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def overlap_needed(n: np.ndarray | int, m: np.ndarray | int, pct: int):
    """Least overlap with which sets of sizes n and m link."""
    return -((-pct * (n + m)) // (100 + pct))


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of ``bits`` bits per set; a shingle flips the bit that it hashes to."""
    out = np.zeros((len(sets), bits), np.uint8)
    sizes = np.array([len(s) for s in sets])
    if sizes.sum():
        at = (mix(np.concatenate(sets).view(np.uint64)) >> _U(20)) % _U(bits)
        flat = np.repeat(np.arange(len(sets)), sizes) * bits + at.astype(np.int64)
        out = (np.bincount(flat, minlength=len(sets) * bits) & 1).astype(np.uint8).reshape(len(sets), bits)
    return np.packbits(out, axis=1).view(np.uint64)


def links_of(sets: list[np.ndarray], side: np.ndarray, pct: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, js, overlaps): every link between the sets of a tile once, by the smaller set i.

    ``side``: -1 for every set compares all sets; otherwise only sets of unlike sides
    are compared (each block's own pairs have a tile of their own).
    """
    order = np.array(sorted(range(len(sets)), key=lambda i: len(sets[i])))
    sets = [sets[i] for i in order]
    side = side[order]
    n = np.array([len(s) for s in sets], np.int64)
    bits = 64 << max(0, min(6, int(n.max() - 1).bit_length() - 6))
    maps = bitmaps(sets, bits)
    # shingles by their numbers in the tile, so an intersection is a look-up
    distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
    number = np.split(number, np.cumsum(n)[:-1])
    own = np.zeros(len(distinct), bool)
    for i in range(len(sets) - 1):
        end = np.searchsorted(n, 100 * n[i] // pct, side="right")
        js = np.arange(i + 1, end)
        if side[i] >= 0:
            js = js[side[i + 1 : end] != side[i]]
        if not len(js):
            continue
        differ = np.bitwise_count(maps[js] ^ maps[i]).sum(1, dtype=np.int64)
        need = overlap_needed(n[i], n[js], pct)
        keep = (n[i] + n[js] - differ) // 2 >= need
        js, need = js[keep], need[keep]
        if not len(js):
            continue
        own[number[i]] = True
        starts = np.concatenate([[0], np.cumsum(n[js])[:-1]])
        overlap = np.add.reduceat(own[np.concatenate([number[j] for j in js])], starts, dtype=np.int64)
        own[number[i]] = False
        linked = overlap >= need
        if linked.any():
            yield int(order[i]), order[js[linked]], overlap[linked]


def _tile_links(batches: Iterator[pa.RecordBatch], pct: int):
    """Per tile: classes, class sizes, sizes of sets, and :func:`links_of` of its distinct classes."""
    for tile in common.grouped(batches, "tile"):
        cls = tile.column("cls").to_numpy()
        _, first = np.unique(cls, return_index=True)
        if len(first) < 2:
            continue
        first.sort()
        sets = list(_arrays(tile.column("set")))
        sets = [sets[i] for i in first]
        yield cls[first], tile.column("copies").to_numpy()[first], links_of(sets, tile.column("side").to_numpy()[first], pct)


def _tile_rows(pct: int):
    """Per tile: (a, b, null) for the links of a spanning forest, (a, null, linked documents) for each linked class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cls, copies, links in _tile_links(batches, pct):
            label, count, ends = np.arange(len(cls)), np.zeros(len(cls), np.int64), []
            for i, js, _ in links:
                count[i] += copies[js].sum()
                count[js] += copies[i]
                found, at = np.unique(label[js], return_index=True)
                new = found != label[i]
                if new.any():
                    ends += [(i, j) for j in js[at[new]].tolist()]
                    label[np.isin(label, found[new])] = label[i]
            linked = np.flatnonzero(count)
            if len(linked):
                a, b = (cls[list(x)] for x in zip(*ends))
                none = pa.nulls(len(linked), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([a, cls[linked]]), pa.int64()),
                        pa.concat_arrays([pa.array(b, pa.int64()), none]),
                        pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(count[linked], pa.int64())]),
                    ],
                    names=["a", "b", "links"],
                )

    return run


def _link_rows(pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cls, _, links in _tile_links(batches, pct):
            for i, js, overlap in links:
                a, b = np.minimum(cls[i], cls[js]), np.maximum(cls[i], cls[js])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, overlap)], names=["class_a", "class_b", "overlap"])

    return run


def _deal(members: DataFrame, pct: int, tile_rows: int) -> DataFrame:
    """``cls, copies, tile, side``: every class of a cluster in each tile of its blocks.

    A block is (cluster, size band, salt); the number of salts follows from the
    members counted in that band.
    """
    step = float(np.log(100 / pct))
    members = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    counts = members.groupBy("cluster", "band").agg(F.count("*").alias("m"))
    # whole clusters of up to tile_rows members are one tile
    salts = counts.groupBy("cluster").agg(
        F.sum("m").alias("all"),
        F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("m") / tile_rows).cast("int").alias("s")))).alias("salts"),
    )
    small = members.join(salts, "cluster")
    one = small.where(F.col("all") <= tile_rows).select("cls", "copies", F.xxhash64("cluster").alias("tile"), F.lit(-1).cast("long").alias("side"))
    salt = F.pmod(F.xxhash64("cls", F.lit("salt")), F.col("salts")[F.col("band")]).cast("int")
    large = small.where(F.col("all") > tile_rows).withColumn("salt", salt)
    # sizes that link lie in the same band or one of the two next ones (the bands' edges are rounded)
    near = F.flatten(
        F.transform(
            F.array(*[F.lit(d) for d in (-2, -1, 0, 1, 2)]),
            lambda d: F.transform(
                F.when(F.col("salts")[F.col("band") + d].isNotNull(), F.sequence(F.lit(0), F.col("salts")[F.col("band") + d] - 1)).otherwise(
                    F.array().cast("array<int>")
                ),
                lambda s: F.struct((F.col("band") + d).alias("band"), s.alias("salt")),
            ),
        )
    )
    own = F.struct("band", "salt")
    large = large.select("cls", "copies", "cluster", own.alias("own"), F.explode(near).alias("other"))
    same = F.col("own") == F.col("other")
    tile = F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other"))
    return one.union(
        large.select("cls", "copies", tile.alias("tile"), F.when(same, -1).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("long").alias("side"))
    )


def _tiles(docs: DataFrame, k: int, pct: int, tile_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, tiles): ``doc_id, tid, n, cls`` per document; the classes; the dealt sets, sorted by tile.

    ``tid`` is a hash of the text, which tells rows of one doc_id apart; ``first`` of a class
    is its smallest row (null ids last).
    """
    spark = docs.sparkSession
    common.prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("tid", F.xxhash64("text"))
    named = with_shingles(docs, k, ["doc_id", "tid"]).mapInArrow(_name_rows(pct), "doc_id long, tid long, n long, cls long, names array<long>")
    named = common.written(named, "join-names")
    rows = named.select("doc_id", "tid", "n", "cls")

    # 3. clusters
    given = named.where("names is not null").select(F.explode("names").alias("name"), "cls")
    given = given.repartition(parts, "name").sortWithinPartitions("name", "cls")
    clusters = common.connected_components(given.mapInArrow(_chain_rows, "a long, b long"))
    clusters = clusters.select(F.col("node").alias("cls"), F.col("label").alias("cluster"))

    # 4. tiles: one document of every class of a cluster gives the set
    order = F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "tid")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min(order).alias("first"), F.first("n").alias("n"), F.count("*").alias("copies"))
    members = common.written(classes.join(clusters, "cls"), "join-members")
    wanted = members.select(F.col("first.doc_id").alias("doc_id"), F.col("first.tid").alias("tid"), "cls")
    # the ids wanted are the smaller side; Spark broadcasts them only below its own size limit
    # the same plan at every size: texts move once, the ids are the hashed side
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["tid"] == wanted["tid"])
    found = docs.join(wanted.hint("shuffle_hash"), same).select("text", "cls")
    # two texts could share id and hash: only the one that gives the class's set counts
    sets = with_shingles(found, k, ["cls"]).mapInArrow(_own_sets, "cls long, set array<long>")
    dealt = _deal(members, pct, tile_rows)
    tiles = sets.join(dealt, "cls").repartition(parts, "tile").sortWithinPartitions("tile")
    return rows, classes, tiles.select("tile", "cls", "copies", "side", "set")


def _answer(docs: DataFrame, k: int, pct: int, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows, answer): the documents' rows, and ``cls, first, copies, n_links, keep`` (the component's smallest row) per class."""
    rows, classes, tiles = _tiles(docs, k, pct, tile_rows)
    found = common.written(tiles.mapInArrow(_tile_rows(pct), "a long, b long, links long"), "join-links")
    comps = common.connected_components(found.where("b is not null").select("a", "b"))
    comps = comps.select(F.col("node").alias("cls"), F.col("label").alias("comp"))
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    least = classes.join(comps, "cls", "left").join(counts, "cls", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    least = least.select("cls", "first", n_links.alias("n_links"), F.coalesce("comp", "cls").alias("comp"))
    smallest = least.groupBy("comp").agg(F.min("first").alias("keep"))
    return rows, least.join(smallest, "comp").select("cls", "first", "n_links", "keep")


def jaccard_components(docs: DataFrame, k: int = 4, pct: int = 85, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links),
    class_id (names its set; null for an empty one) and n_links (documents linked with it, equal sets included).

    ``k`` words make a shingle and ``pct`` is the least Jaccard similarity in percent.
    """
    rows, answer = _answer(docs, k, pct, tile_rows)
    return rows.join(answer.select("cls", "n_links", F.col("keep.doc_id").alias("component_id")), "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("cls").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def class_links(docs: DataFrame, k: int = 4, pct: int = 85, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Every link between different classes: class_a < class_b (``class_id``), doc_a and doc_b (their smallest ids), overlap.

    As many rows as there are linked pairs of different sets: the square of a group of near copies.
    """
    _, classes, tiles = _tiles(docs, k, pct, tile_rows)
    links = tiles.mapInArrow(_link_rows(pct), "class_a long, class_b long, overlap long")
    a, b = (classes.select(F.col("cls").alias(f"class_{x}"), F.col("first.doc_id").alias(f"doc_{x}")) for x in "ab")
    return links.join(a, "class_a").join(b, "class_b").select("class_a", "class_b", "doc_a", "doc_b", "overlap")


def near_dedup(docs: DataFrame, unnamed: bool = False, **params) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, then text hash, with all its columns.

    Rows are told apart by doc_id and text; of rows equal in both, one stays. Documents with an
    empty set stay. Rows with a null doc_id come last; they are dropped as copies only with ``unnamed``.
    """
    rows, answer = _answer(docs, **({"k": 4, "pct": 85, "tile_rows": TILE_ROWS} | params))
    # only rows of a component with more rows can go
    found = rows.join(answer.where("n_links > 0 or first <> keep").select("cls", "keep"), "cls")
    if not unnamed:
        found = found.where("doc_id is not null")
    other = ~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("tid") == F.col("keep.tid")))
    found = common.written(found.select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid"), other.alias("__other")), "join-found")
    tagged = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__text": F.xxhash64(F.col("text").cast("string"))})
    same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__tid"))
    kept = tagged.join(found.where("__other").drop("__other").distinct(), same, "left_anti")
    # the kept row itself may be repeated
    again = found.where("not __other").groupBy("__id", "__tid").count().where("count > 1").drop("count")
    if not again.isEmpty():
        once = kept.join(again, same, "left_semi").dropDuplicates(["__doc", "__text"])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.drop("__doc", "__text")
