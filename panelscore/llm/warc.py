"""WARC archives: writing with revisit records, reading with boundary-chain verification.

Writing: payload digests are grouped; of equal payloads of at least ``min_revisit`` bytes
the one with the largest page_id becomes a ``response``, the others become ``revisit``
records without a body that name it. Records are written by Spark's own committer
(``.warc`` files of concatenated records), so a lost executor leaves no broken file.

Reading: any place in a file that looks like a record start (version line, parsable
header) is only a candidate, since payloads may hold such text. Tasks emit, for
every candidate, the offset of its successor, which follows from its Content-Length.
Pointer jumping from the start of each file (the known set doubles its reach in every
round) retains the reachable candidates; what lies inside a payload is never reached.

Scale: pages are moved only where a revisit may be known for them; chains are (file, offset,
successor) rows, joined on both, without payloads. An archive is read in one task, so
the writer bounds its bytes (``archive_bytes``): records are written in classes of size, each with as
many records to a file as fit at the class's upper bound, the largest one by one.

Defined results: null html is an empty payload; repeated page_ids give as many
records and rows; of equal payloads with equal page_id one row is the response; a null
page_id is smaller than any other; an empty table gives no archive and no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from . import common

VERSION = "WARC/1.1"
MIN_REVISIT = 1000
#: Bytes of an archive, but for a single larger record; an archive is read in one task.
ARCHIVE_BYTES = 64 << 20
#: Records are written by size, those of a class with as many to a file as fit by its upper bound.
RECORD_CLASSES = (16 << 10, 256 << 10)
#: 64-bit words of the bitmap of repeated payloads (2 MB as a broadcast table).
BITMAP_WORDS = 1 << 17
#: Date of the synthetic captures (the pages carry none).
CAPTURE_DATE = "2024-01-01T00:00:00Z"

_END = "\r\n\r\n"


def page_rows(pages: DataFrame) -> DataFrame:
    """rid, page_id, url, payload, payload_bytes, payload_digest of each page."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha1(body.cast("binary")).alias("payload_digest"),
    )


def revisits(rows: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, payload_digest, refers_to, n_revisits`` of the pages that only repeat another page's payload.

    Sizes and largest ids are aggregated per payload before the shuffle.
    """
    big = rows.where(F.col("payload_bytes") >= min_revisit).select("page_id", "payload_digest", "payload_bytes")
    each = big.groupBy("payload_digest", "payload_bytes", "page_id").agg(F.count("*").alias("rows"))
    top = each.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.sum("rows").alias("all"))
    again = each.join(top.where("all > 1").select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "refers_to"), (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")))
    first = F.col("page_id").eqNullSafe(F.col("refers_to"))
    return again.select("page_id", "payload_digest", "refers_to", (F.col("rows") - F.when(first, 1).otherwise(0)).alias("n_revisits"), first.alias("has_response")).where("n_revisits > 0")


def _one_line(col):
    """A header value holds no line break."""
    return F.regexp_replace(col, r"[\r\n]+", " ")


def record_text(row_type, refers_to) -> F.Column:
    """The record of a row of :func:`page_rows` as text: header, blank line, block."""
    revisit = row_type == "revisit"
    head = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), row_type),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("rid").cast("string"), F.lit(">")),
        F.lit(f"WARC-Date: {CAPTURE_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page: "), F.coalesce(refers_to.cast("string"), F.lit("")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ]
    return F.concat(F.concat_ws("\r\n", *head), F.lit(_END), F.when(revisit, F.lit("")).otherwise(F.col("payload")))


def _flag(digest) -> tuple[F.Column, F.Column]:
    """(word, bit) of a digest in the bitmap of repeated payloads."""
    h = F.xxhash64(digest)
    return F.pmod(h, F.lit(BITMAP_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int"))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per page under ``path``.

    A bitmap of the digests that have revisits (bounded by BITMAP_WORDS) tells most pages
    that they have none: they are written where they were read. The others meet their
    revisit by a join.
    """
    rows = page_rows(pages)
    again = common.written(revisits(rows, min_revisit), "warc-revisits")
    word, bit = _flag(F.col("payload_digest"))
    bits = again.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask"))
    flagged = rows.withColumn("word", word).join(F.broadcast(bits), "word", "left")
    flagged = flagged.withColumn("maybe", F.coalesce(F.col("mask").bitwiseAND(bit) != 0, F.lit(False))).drop("word", "mask")

    again = again.select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "refers_to", "has_response")
    met = flagged.where("maybe").join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    kind = F.when(F.col("d").isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))
    if not again.where("has_response").isEmpty():
        # of rows repeated with the responding id, one responds
        turn = F.row_number().over(Window.partitionBy("page_id", "payload_digest").orderBy("rid"))
        met = met.withColumn("turn", turn)
        kind = F.when(F.col("has_response") & (F.col("turn") == 1), F.lit("response")).otherwise(kind)
    alone = flagged.where("not maybe").select(record_text(F.lit("response"), F.lit(None)).alias("value"))
    out = alone.union(met.select(record_text(kind, F.col("refers_to")).alias("value")))
    out = out.withColumn("size", F.octet_length("value"))
    # records of the larger classes are rare: their writes are left out where there can be none
    largest = rows.agg(F.max(F.col("payload_bytes") + F.octet_length("url"))).first()[0] or 0
    edges = [0, *RECORD_CLASSES]
    for low, high in zip(edges, [*RECORD_CLASSES, None]):
        # a header is short but for the url, which counts twice at most
        if low and 2 * largest + 4096 <= low:
            break
        some = out.where(F.col("size") >= low) if high is None else out.where((F.col("size") >= low) & (F.col("size") < high))
        per_file = max(1, archive_bytes // high) if high else 1
        some.select("value").write.mode("append").option("lineSep", _END).option("maxRecordsPerFile", per_file).text(path)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")
_CANDIDATE_SCHEMA = (
    "path string, start long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, body_digest string"
)


def header_fields(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n"):
        name, sep, value = line.partition(":")
        if sep:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _number(text: str | None) -> int | None:
    """A signed 64-bit number."""
    n = int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def candidates_of(data: bytes) -> Iterator[tuple]:
    """(start, next, page_id, payload_bytes, payload_digest, record_type, refers_to, digest of the block) of each possible record.

    The search goes on behind a header, not behind its block, so candidates inside payloads are found too.
    """
    at = 0
    while (m := _HEAD.search(data, at)) is not None:
        at = m.end()
        fields = header_fields(m.group(1))
        length = _number(fields.get("content-length"))
        kind = fields.get("warc-type")
        if length is None or not 0 <= length < 1 << 62 or kind is None:
            at = m.start() + 1
            continue
        end = m.end() + length
        yield (
            m.start(), end + len(_END), _number(fields.get("x-page-id")), _number(fields.get("x-payload-length")),
            (fields.get("warc-payload-digest") or "").removeprefix("sha1:"), kind, _number(fields.get("x-refers-to-page")),
            hashlib.sha1(memoryview(data)[m.end() : end]).hexdigest(),
        )


def _candidate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["start", "next", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "body_digest"]
    for batch in batches:
        for i in range(batch.num_rows):
            path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer().to_pybytes()
            found = list(candidates_of(data))
            if found:
                cols = [pa.array(c, t) for c, t in zip(zip(*found), types)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), *cols], names=["path", *names])


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Possible records of the archives under ``path``, with the offset of each one's successor."""
    common.prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_candidate_rows, _CANDIDATE_SCHEMA)


def reachable(links: DataFrame, max_rounds: int = 48) -> DataFrame:
    """``path, start`` of the candidates on the chain from offset 0 of each file.

    ``links`` has path, start, next. In round k, jumps lead 2**k records ahead and the known
    candidates are joined with them, so a chain of n records needs log2(n) rounds.
    """
    ends = links.select("path", F.col("start").alias("next"))
    jump = common.written(links.join(ends, ["path", "next"], "left_semi").select("path", "start", "next"), "warc-jump")
    known = common.written(links.where("start = 0").select("path", "start"), "warc-known")
    for _ in range(max_rounds):
        ahead = known.join(jump, ["path", "start"]).select("path", F.col("next").alias("start"))
        grown = common.written(known.union(ahead).distinct(), "warc-known")
        if jump.isEmpty():
            return grown
        known = grown
        onward = jump.select("path", F.col("start").alias("next"), F.col("next").alias("to"))
        jump = common.written(jump.join(onward, ["path", "next"]).select("path", "start", F.col("to").alias("next")), "warc-jump")
    raise RuntimeError("a chain of records does not end")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, body_digest."""
    found = common.written(read_candidates(spark, path), "warc-candidates")
    kept = reachable(found.select("path", "start", "next"))
    return found.join(kept, ["path", "start"]).drop("path", "start", "next")


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages written as WARC records and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response whose block does not give its recorded digest is an error.
    """
    spark = pages.sparkSession
    common.prepare(spark)
    path = scratch_path(spark, "llm-warc")
    write_archives(pages, path, min_revisit)
    back = read_archives(spark, path)
    bad = (F.col("record_type") == "response") & (F.col("body_digest") != F.col("payload_digest"))
    digest = F.when(bad, F.raise_error(F.lit("a record's block does not match its digest"))).otherwise(F.col("payload_digest"))
    return back.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
