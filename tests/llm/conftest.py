import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text[, lang[, source]]) tuples, in two partitions."""

    def make(rows, schema=DOC, parts=2):
        full = [tuple(r) + ("en", "s0", 0)[len(r) - 2 :] if schema is DOC else tuple(r) for r in rows]
        return spark.createDataFrame(full, schema).repartition(parts) if full else spark.createDataFrame([], schema)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """All documents of the smallest test table, as dicts."""
    return [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


@pytest.fixture(scope="session")
def sample_dir():
    return "/root/testdata/sf0.001"
