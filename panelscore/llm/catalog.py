"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe,
    exact_dedup,
    html_extract,
    langid,
    mixing,
    ngram_join,
    periodic_runs,
    quality,
    sentencepiece_bpe,
    substring_dedup,
    suffix_dedup,
    warc,
    whitening,
)
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


@register("op1_substring_dedup")
def op1_substring_dedup(spark, sf):
    """Texts without the sentences of repeated runs (two sentences or more, twenty words or more)."""
    return substring_dedup.remove_repeats(read_table(spark, sf, "documents"), whole=True)


@register("op2_bpe")
def op2_bpe(spark, sf):
    """Ids of every whole text, and the text decoded from them."""
    return bpe.encode_digests(read_table(spark, sf, "documents"))


@register("op3_warc")
def op3_warc(spark, sf):
    """Pages written as WARC records and read back through the verified record chain."""
    return warc.round_trip(read_table(spark, sf, "pages"))


@register("op4_html_extraction")
def op4_html_extraction(spark, sf):
    """Main text of every page, by the template of its host."""
    return html_extract.extract(read_table(spark, sf, "pages"))


@register("op5_suffix_array_dedup")
def op5_suffix_array_dedup(spark, sf):
    """Bytes left when every byte covered by a repeated 400-byte string is dropped."""
    return suffix_dedup.remove_repeated_bytes(read_table(spark, sf, "documents"), length=400)


@register("op6_mixing")
def op6_mixing(spark, sf):
    """Uses of documents in a mixture in which every source is used once or more, at most four times."""
    return mixing.mix(read_table(spark, sf, "documents")).drop("rid")


@register("op7_language_id")
def op7_language_id(spark, sf):
    """Language of every text, learnt from the labelled documents outside the held-out fold."""
    return langid.language_id(read_table(spark, sf, "documents"))


@register("op8_exact_dedup")
def op8_exact_dedup(spark, sf):
    """Groups of equal texts (white-space runs count as one space)."""
    return exact_dedup.dedup_rows(read_table(spark, sf, "documents")).drop("chain")


@register("op9_ngram_join")
def op9_ngram_join(spark, sf):
    """Class, number of links and component of every document; 4-word shingle sets with a Jaccard similarity of 0.85 or more link."""
    return ngram_join.jaccard_components(read_table(spark, sf, "documents"), k=4, pct=85)


@register("op10_quality_rules")
def op10_quality_rules(spark, sf):
    """Base rules and the n-gram log-likelihood ratio of every document, against a calibrated threshold."""
    return quality.quality(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"), threshold=None)


@register("op11_sentencepiece")
def op11_sentencepiece(spark, sf):
    """Ids of every whole text by the prefix table, end id last, and the text decoded from them."""
    return sentencepiece_bpe.encode_digests(read_table(spark, sf, "documents"))


@register("op12_embedding_whitening")
def op12_embedding_whitening(spark, sf):
    """Whitened components of every vector, from block matrices over the distinct grid vectors."""
    return whitening.whitened_components(read_table(spark, sf, "embeddings"), components=16)


@register("op13_periodic_runs")
def op13_periodic_runs(spark, sf):
    """Maximal periodic word runs of every text and the digest of the text without their repeats."""
    return periodic_runs.run_digests(read_table(spark, sf, "documents"))


@register("pipeline")
def pipeline(spark, sf):
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


ORACLE: dict[str, str] = {
    "op3_warc": """
        WITH p AS (
          SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                 max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
          FROM pages
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM p
    """,
    "op8_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        ), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t
    """,
}
