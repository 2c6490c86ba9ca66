"""The corpus pipeline and the registered queries."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from panelscore.llm import bpe, catalog, common, quality
from tests.llm.test_dedup import components_brute, exact_brute
from tests.llm.test_text_ops import library_row

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.read_table(spark, SF, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = common.written(stage(spark, docs, SF), f"test-{name}")
    return out


def test_columns_and_shrinking(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns
    counts = [stages[n].count() for n in ("documents", *names[:3])]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_quality_stage_is_the_verdict(spark, stages):
    verdict = quality.quality(stages["documents"], common.read_table(spark, SF, "labels"), threshold=None)
    assert {r["doc_id"] for r in rows(stages["quality_rules"])} == {r["doc_id"] for r in rows(verdict.where("kept"))}


def test_exact_stage_matches_brute_force(stages):
    pairs = [(r["doc_id"], r["text"]) for r in rows(stages["quality_rules"])]
    assert {r["doc_id"] for r in rows(stages["exact_dedup"])} == {r[0] for r in exact_brute(pairs) if r[3]}


def test_near_stage_matches_brute_force(stages):
    pairs = [(r["doc_id"], r["text"]) for r in rows(stages["exact_dedup"])]
    assert {r["doc_id"] for r in rows(stages["near_dedup"])} == {i for i, _, c in components_brute(pairs, 5, 80) if i == c}


def test_mixing_stage_loses_no_document(stages):
    uses = Counter(r["doc_id"] for r in rows(stages["mixing"]))
    assert set(uses) == {r["doc_id"] for r in rows(stages["near_dedup"])} and max(uses.values()) <= 2


def test_bpe_stage_equals_the_library(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_model())
    expected = sorted((r["doc_id"], *library_row(library, r["text"])) for r in rows(stages["mixing"]))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(stages["bpe"])) == expected


def test_run_is_the_chain_of_stages(spark, stages):
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in rows(corpus_pipeline.run(spark, SF)))
    assert got == sorted((r["doc_id"], r["ids_sha256"]) for r in rows(stages["bpe"]))


def test_stages_take_an_empty_table(spark, stages):
    docs = stages["documents"].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {int(n.split("_")[0][2:]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    expected = con.execute(catalog.ORACLE[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    key = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert [x.replace(".0", "") for x in key(got)] == [x.replace(".0", "") for x in key(expected)]


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for path in (root / "panelscore").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text().replace("llm_", ""), path
