"""Résumé/job matching and context retrieval as token joins (ATS-1, ATS-2, RET-1, JN-7).

Documents are tokenised once per row (``explode`` of the row's own token
array). Corpus statistics (document frequency) are pre-aggregated per token
with map-side combine; joins to the per-token table are equi joins on the
token, where AQE's skew-join split spreads a very frequent token over many
tasks. Pairing is always through an explicit key (applications) or shared
tokens, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.tokens import is_token, token_array
from .joins import bounded_broadcast, numbered, partition_keys, spread

TOP_TERMS = 5


QUERY_BROADCAST_ROWS = 2_000_000  # tokens of the queries broadcast to the document side (checked)
FREQUENCY_BROADCAST_ROWS = 4_000_000  # tokens with their document frequencies (checked)
BLOCK_POSTINGS = 12_000_000  # (document, token) pairs of a block of documents
COMMON = 1 / 64  # share of a block's documents from which a token is looked up in bits
SEEDS = 48  # leading documents that get their whole scores first
LOOKUPS = 4  # common tokens looked up before documents are left out again


def checkpointed(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder (see ``session.materialize``)."""
    from ..session import materialize

    return materialize(df, name)


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, tf) for every token of every document (partial counts map-side)."""
    t = docs.select(id_col, F.explode(token_array(F.col(text_col))).alias("token")).where(is_token(F.col("token")))
    return t.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"))


def token_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token) distinct pairs; deduplicated inside each row, so no shuffle.

    The length rule is a row filter after ``explode`` (code-generated), not a
    lambda over the array (higher-order functions are interpreted per element).
    """
    pieces = F.array_distinct(token_array(F.col(text_col)))
    return docs.select(id_col, F.explode(pieces).alias("token")).where(is_token(F.col("token")))


# --------------------------------------------------------------------------- ATS-1


def _ranked_terms(flag, k):
    """', '-joined tokens with ``flag`` among the first ``k`` (rank column ``_rn``)."""
    picked = F.collect_list(F.when(flag & (F.col("_rn") <= k), F.struct("_rn", "token")))
    return F.array_join(F.transform(F.array_sort(picked), lambda x: x["token"]), ", ")


def keyword_match(applications: DataFrame, resumes: DataFrame, jobs: DataFrame, k: int = TOP_TERMS) -> DataFrame:
    """ATS-1: share of the job's distinct tokens found in the résumé, 0..100 (1 decimal).

    strengths / gaps = up to ``k`` matched / missing job tokens, most frequent in
    the job first, ties by token. One window (ranks within matched / missing)
    and one aggregate per application, both on the same hash partitioning.
    """
    keys = ["job_id", "resume_id"]
    jt = token_counts(spread(jobs), "job_id", "jd")
    rt = token_sets(spread(resumes), "resume_id", "resume").withColumn("_hit", F.lit(True))
    pairs = applications.select(*keys).join(jt, "job_id")
    m = pairs.join(rt, ["resume_id", "token"], "left").select(
        *keys, "token", "tf", F.coalesce("_hit", F.lit(False)).alias("matched")
    )
    # one hash partitioning by application serves both the rank window (its keys
    # are a superset) and the aggregate, instead of a shuffle for each
    m = m.repartition(*keys)
    w = Window.partitionBy(*keys, "matched").orderBy(F.desc("tf"), F.asc("token"))
    agg = m.withColumn("_rn", F.row_number().over(w)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("job_tokens"),
        F.count(F.when(F.col("matched"), 1)).alias("matched_tokens"),
        _ranked_terms(F.col("matched"), k).alias("strengths"),
        _ranked_terms(~F.col("matched"), k).alias("gaps"),
    )
    out = applications.select(*keys).join(agg, keys, "left")
    return out.select(
        *keys,
        F.coalesce("job_tokens", F.lit(0)).alias("job_tokens"),
        F.coalesce("matched_tokens", F.lit(0)).alias("matched_tokens"),
        F.bround(F.try_divide(100.0 * F.col("matched_tokens"), F.col("job_tokens")), 1).alias("score"),
        F.coalesce("strengths", F.lit("")).alias("strengths"),
        F.coalesce("gaps", F.lit("")).alias("gaps"),
    )


# --------------------------------------------------------------------------- ATS-2


def semantic_match(applications: DataFrame, resumes: DataFrame, jobs: DataFrame, digits: int = 6) -> DataFrame:
    """ATS-2: tf-idf cosine of résumé and job, idf over résumés + jobs (N documents).

    Texts are shuffled, tokens are not: once by document for the document frequencies, once by
    application for the counts of its two texts, which also give the norms. Tokens of a single
    document need no row among the frequencies, so these are small enough to broadcast as a rule.
    """
    docs = resumes.select(F.concat(F.lit("r"), F.col("resume_id").cast("string")).alias("doc"), F.col("resume").alias("text")) \
        .unionByName(jobs.select(F.concat(F.lit("j"), F.col("job_id").cast("string")).alias("doc"), F.col("jd").alias("text")))
    n_docs = docs.agg(F.count(F.lit(1)).cast("double")).scalar()
    # rows of one id are one document: its tokens are told apart where its texts stand together
    tokens = token_sets(docs.repartition("doc"), "doc", "text").groupBy("doc", "token").agg(F.lit(1).alias("one"))
    df_ = checkpointed(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")

    app = applications.select(
        "job_id", "resume_id",
        F.concat(F.lit("j"), F.col("job_id").cast("string")).alias("jdoc"),
        F.concat(F.lit("r"), F.col("resume_id").cast("string")).alias("rdoc"),
    )
    keys = ["jdoc", "rdoc"]
    pairs = app.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    sides = [
        pairs.join(docs.select(F.col("doc").alias(key), "text"), key).select(*keys, "times", F.lit(key == "jdoc").alias("job"), "text")
        for key in keys
    ]
    texts = sides[0].unionByName(sides[1]).repartition(*keys)
    piece = texts.select(*keys, "times", "job", F.explode(token_array(F.col("text"))).alias("token")).where(is_token(F.col("token")))
    tf = piece.groupBy(*keys, "times", "token").agg(F.count(F.when(F.col("job"), 1)).alias("tj"), F.count(F.when(~F.col("job"), 1)).alias("tr"))
    met = tf.join(bounded_broadcast(df_, FREQUENCY_BROADCAST_ROWS), "token", "left")
    idf = F.log(n_docs / F.coalesce("df", F.lit(1)))
    w = met.select(*keys, "times", (F.col("tj") * idf).alias("wj"), (F.col("tr") * idf).alias("wr"))
    # an application that stands twice counts its products twice
    sums = w.groupBy(*keys, "times").agg(
        F.sum(F.col("wj") * F.col("wr")).alias("dot"),
        F.sqrt(F.sum(F.col("wj") * F.col("wj"))).alias("nj"),
        F.sqrt(F.sum(F.col("wr") * F.col("wr"))).alias("nr"),
    )
    cos = F.try_divide(F.col("dot") * F.col("times"), F.col("nj") * F.col("nr"))
    return app.join(sums, keys, "left").select("job_id", "resume_id", F.bround(cos, digits).alias("cosine"))


# --------------------------------------------------------------------------- RET-1


def exact_round(x: np.ndarray, digits: int) -> np.ndarray:
    """``bround`` of doubles: half-even by their shortest decimal text, looked at only near a half."""
    scaled = x * 10.0**digits
    out = np.round(x, digits)
    for i in np.flatnonzero(np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN))
    return out


class Postings:
    """Postings of documents numbered in id order: per token its documents, and a bit a document for common tokens.

    ``times`` has how often a document that stands more than once has the token; such documents get no bits.
    """

    def __init__(self, tids: np.ndarray, docs: np.ndarray, times: np.ndarray | None, n: int, common: float):
        starts = np.flatnonzero(np.append(True, tids[1:] != tids[:-1])) if len(tids) else np.empty(0, np.int64)
        self.tokens, self.edges = tids[starts], np.append(starts, len(tids))
        self.docs, self.times, self.sizes = docs, times, np.diff(self.edges)
        self.most = 1.0 if times is None else times.max(initial=1.0)
        self.sums = np.zeros(n)  # all zero between queries
        frequent = np.flatnonzero(self.sizes > n * common) if times is None else []
        self.row = np.full(len(starts), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.bits = np.zeros((len(frequent), -(-n // 8)), np.uint8)
        for bits, t in zip(self.bits, frequent):
            has = np.zeros(n, np.bool_)
            has[docs[self.edges[t] : self.edges[t + 1]]] = True
            bits[:] = np.packbits(has, bitorder="little")

    def _looked_up(self, rows: np.ndarray, idfs: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """What common tokens add to the scores of a few documents."""
        return idfs @ ((self.bits[rows[:, None], docs >> 3] >> (docs & 7).astype(np.uint8)) & 1)

    def best(self, tids: np.ndarray, idfs: np.ndarray, ends: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, places and scores of all documents that can be among a query's ``k`` best, by any that can differ by less than ``margin``."""
        query = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        at = np.searchsorted(self.tokens, tids)
        here = at < len(self.tokens)
        here[here] = self.tokens[at[here]] == tids[here]
        at, idfs, query = at[here], idfs[here], query[here]
        # tokens without bits first, rare ones before others
        order = np.lexsort((-idfs, self.row[at] >= 0, query))
        at, idfs = at[order], idfs[order]
        rows, sizes, starts, stops = self.row[at], self.sizes[at], self.edges[at].tolist(), self.edges[at + 1].tolist()
        without = np.bincount(query[rows < 0], minlength=len(ends)).tolist()
        out, first = [], 0
        for i, last in enumerate(np.cumsum(np.bincount(query, minlength=len(ends))).tolist()):
            if last > first:
                span = slice(first, last)
                found, scores = self._best(idfs[span], rows[span], sizes[span], starts[span], stops[span], max(1, without[i]), k, margin)
                out.append((np.full(len(found), i), found, scores))
            first = last
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def _best(self, idfs, rows, sizes, starts: list[int], stops: list[int], j: int, k: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """The same for one query, of which the first ``j`` tokens are summed at once."""
        end, done, parts = len(idfs), 0, []
        # the most that a document can get from the tokens not yet summed
        rest = np.zeros(end + 1)
        np.cumsum(idfs[::-1] * self.most, out=rest[:-1])
        rest[:-1] = rest[-2::-1]
        while True:
            new = [self.docs[a:b] for a, b in zip(starts[done:j], stops[done:j])]
            weights = np.repeat(idfs[done:j], sizes[done:j])
            if self.times is not None:
                weights *= np.concatenate([self.times[a:b] for a, b in zip(starts[done:j], stops[done:j])])
            parts += new
            seen = np.concatenate(parts)
            np.add.at(self.sums, np.concatenate(new) if done else seen, weights)
            done, got = j, self.sums[seen]
            # whole scores of those that lead so far: the k-th of them is the least that counts
            lead = np.unique(seen[got.argpartition(len(got) - SEEDS)[-SEEDS:]] if len(got) > SEEDS else seen)
            least = 0.0
            if len(lead) >= k:
                whole = self.sums[lead]
                if j < end:
                    whole += self._looked_up(rows[j:], idfs[j:], lead)
                whole.sort()
                least = whole[-k] - margin
            if j == end or rest[j] < least:
                break
            # documents without any token summed so far can still count: more tokens are summed
            j = min(end, max(j + 1, int((-rest).searchsorted(-least, side="right")))) if least > 0 else end
        found = np.unique(seen[got >= least - rest[j]])
        scores = self.sums[found]
        self.sums[seen] = 0.0
        while j < end:
            a, j = j, end if len(found) <= SEEDS else min(j + LOOKUPS, end)
            scores += self._looked_up(rows[a:j], idfs[a:j], found)
            live = scores >= least - rest[j]
            found, scores = found[live], scores[live]
        return found, scores


class Block:
    """One block of documents, numbered in id order; those that have a token more than once stand apart."""

    def __init__(self, ids: pa.Array, tids: pa.ListArray, common: float):
        coded = ids.dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.ids, n = coded.dictionary.take(pa.array(order)), len(order)
        place = place[coded.indices.to_numpy()]
        in_order = np.argsort(place, kind="stable")
        sizes = pc.list_value_length(tids).to_numpy()
        docs = np.repeat(place[in_order], sizes[in_order])
        flat = tids.take(pa.array(in_order)).flatten().to_numpy()
        by_token = np.argsort(flat, kind="stable")
        flat, docs = flat[by_token], docs[by_token]
        del by_token
        again = np.flatnonzero((flat[1:] == flat[:-1]) & (docs[1:] == docs[:-1])) + 1
        if not len(again):
            self.parts = [Postings(flat, docs, None, n, common)]
            return
        # documents that stand twice count their tokens twice
        twice = np.zeros(n, np.bool_)
        twice[docs[again]] = True
        apart = twice[docs]
        first = np.append(True, (flat[1:] != flat[:-1]) | (docs[1:] != docs[:-1]))[apart]
        heads = np.flatnonzero(first)
        times = np.diff(np.append(heads, len(first))).astype(np.float64)
        self.parts = [Postings(flat[~apart], docs[~apart], None, n, common), Postings(flat[apart][heads], docs[apart][heads], times, n, common)]

    def best(self, tids: np.ndarray, idfs: np.ndarray, ends: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, places and scores of each query's ``k`` best documents here (score down, then id)."""
        query, found, scores = (np.concatenate(x) for x in zip(*[part.best(tids, idfs, ends, k, 10.0**-digits * 2) for part in self.parts]))
        rounded = exact_round(scores, digits)
        order = np.lexsort((found, -rounded, query))
        query, found, rounded = query[order], found[order], rounded[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        return query[rank < k], found[rank < k], rounded[rank < k]


def _packed(schema: pa.Schema):
    """(did, tid) rows to one row a run of a document's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.append(0, np.flatnonzero(codes[1:] != codes[:-1]) + 1)
            tids = pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows), pa.int32()), batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), tids.cast(schema.field(1).type)], schema=schema)

    return run


def _best_of_blocks(k: int, digits: int, common: float, schema: pa.Schema):
    """Rows sorted by block, its documents before the queries: the best documents of each query in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            blocks, is_query = batch.column("block").to_numpy(), batch.column("idfs").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            edges = [0, *cuts.tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if blocks[a] != now:
                    now, held, block = blocks[a], [], None
                part = batch.slice(a, b - a)
                if not is_query[a]:
                    held.append(part.select(["did", "tids"]))
                    continue
                if block is None and held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    held = []
                    block = Block(t.column("did").combine_chunks(), t.column("tids").combine_chunks(), common)
                    del t
                if block is None:
                    continue
                ends = np.cumsum(pc.list_value_length(part.column("tids")).to_numpy())
                rows, places, scores = block.best(part.column("tids").flatten().to_numpy(), part.column("idfs").flatten().to_numpy(), ends, k, digits)
                qid = part.column("qid").take(pa.array(rows))
                did = block.ids.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([qid.cast(schema.field(0).type), did.cast(schema.field(1).type), pa.array(scores)], schema=schema)

    return run


def retrieve(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 3,
    hot_fraction: float = 0.1,
    qid: str = "prompt_id",
    qtext: str = "prompt",
    did: str = "doc_id",
    dtext: str = "text",
    digits: int = 6,
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """RET-1: top-``k`` documents per query by the sum of ln(N/df) over distinct shared tokens.

    Ranking: score (rounded to ``digits``) desc, then doc id asc; only documents
    sharing at least one token are returned. Exact, and no pair of a query and a
    document is ever written:

    1. document tokens that occur in a query are numbered, counted, and written as
       one list of numbers a document;
    2. documents are dealt to blocks of about ``block_postings`` such numbers. A block's
       task holds its postings and reads the queries one by one. It adds up a query's
       rare tokens by their postings alone. The documents that lead then get their whole
       scores: the ``k``-th of these is the least that counts, so tokens that cannot add up
       to it bring no document of their own. These (common ones, in more than
       ``hot_fraction`` or ``COMMON`` of the block) are looked up in bits, a few at a time,
       for documents that can still be among the ``k`` best;
    3. the best ``k`` of each block are ranked once more per query.

    The products are (queries x documents) by nature; what is shuffled is the
    postings once, and per block the queries and ``k`` rows of each.
    ``hot_fraction`` trades sums against lookups; the result is exact for any value.
    """
    spark = docs.sparkSession
    q = token_sets(queries, qid, qtext).where(F.col(qid).isNotNull()).groupBy(qid, "token").agg(F.count(F.lit(1)).alias("times"))
    # a written number stays the same for all that read it
    words = checkpointed(numbered(q.select("token").distinct(), ["token"], "tid").select("token", F.col("tid").cast("int")), "words")
    dt = token_sets(spread(docs), did, dtext).join(bounded_broadcast(words, QUERY_BROADCAST_ROWS), "token").select(F.col(did).alias("did"), "tid")
    packed = StructType([StructField("did", docs.schema[did].dataType), StructField("tids", ArrayType(IntegerType()))])
    dt = checkpointed(dt.mapInArrow(_packed(to_arrow_schema(packed)), packed), "doc_tokens")
    n_docs = docs.agg(F.count(F.lit(1)).cast("double")).scalar()
    stats = checkpointed(dt.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    n_rows = stats.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    # tokens absent from every document cannot match
    terms = q.join(words, "token").join(stats, "tid").select(F.col(qid).alias("qid"), "tid", (F.log(n_docs / F.col("df")) * F.col("times")).alias("idf"))
    terms = terms.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("tid", "idf"))).alias("terms"))
    cores = spark.sparkContext.defaultParallelism
    keys = partition_keys(spark, max(2 * cores, -(-n_rows // block_postings)))

    dtype, qtype = docs.schema[did].dataType.simpleString(), queries.schema[qid].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    block = F.element_at(F.lit(keys), (F.pmod(F.xxhash64("did"), F.lit(len(keys))) + 1).cast("int"))
    postings = dt.select(block.alias("block"), "did", "tids", none(qtype).alias("qid"), none("array<double>").alias("idfs"))
    asked = terms.select(F.explode(F.lit(keys)).alias("block"), none(dtype).alias("did"), F.col("terms.tid").alias("tids"), "qid", F.col("terms.idf").alias("idfs"))
    cells = postings.unionByName(asked).repartition(len(keys), "block").sortWithinPartitions("block", F.col("idfs").isNotNull())
    out = StructType([StructField(qid, queries.schema[qid].dataType), StructField(did, docs.schema[did].dataType), StructField("score", DoubleType())])
    best = cells.mapInArrow(_best_of_blocks(k, digits, min(hot_fraction, COMMON), to_arrow_schema(out)), out)
    w = Window.partitionBy(qid).orderBy(F.desc("score"), F.asc(did))
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(qid, did, "rank", "score")
