"""Every registered query against its DuckDB oracle (order-insensitive, rounded to 9 places)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from oracle_check import _rows  # noqa: E402
from panelscore.plans.catalog import QUERIES  # noqa: E402

from data_dirs import SF_SMALL  # noqa: E402

# the training-data operators have their own tests (tests/llm)
NAMES = sorted(QUERIES)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns[0] == "target_model"


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck_small, name):
    pdf = queries()[name](spark, SF_SMALL).toPandas()
    odf = duck_small.execute(oracle_sql()[name]).df()
    assert sorted(pdf.columns) == sorted(odf.columns)
    cols = sorted(pdf.columns)
    assert len(pdf) == len(odf)
    assert _rows(pdf, cols, 9) == _rows(odf, cols, 9)


@pytest.mark.parametrize("hot", [0.01, 0.5])
def test_retrieval_exact_on_real_documents(spark, duck_small, hot):
    """The certified retrieval equals the brute force for any hot-token threshold."""
    from panelscore.operators import textmatch
    from panelscore.plans import fixtures as fx

    got = textmatch.retrieve(
        fx.prompts(spark, SF_SMALL).select("prompt_id", "prompt"),
        fx.read_table(spark, SF_SMALL, "documents").select("doc_id", "text"),
        hot_fraction=hot,
    ).toPandas()
    exp = duck_small.execute(oracle_sql()["retrieve_top3"]).df()
    cols = sorted(got.columns)
    assert sorted(exp.columns) == cols
    assert _rows(got, cols, 9) == _rows(exp, cols, 9)
