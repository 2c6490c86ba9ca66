"""Docs do not drift from the registry: README, PLANS and COVERAGE list what is registered."""

import os
import re

from panelscore.plans.catalog import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _table_keys(name):
    text = open(os.path.join(ROOT, name), encoding="utf-8").read()
    return set(re.findall(r"^\| `([a-z0-9_]+)` \|", text, re.M))


def test_readme_and_plans_list_every_query():
    # the training-data queries have a table of their own
    assert {k for k in _table_keys("README.md") if not re.match(r"op\d+_|pipeline$", k)} == set(QUERIES)
    assert _table_keys("PLANS.md") == set(QUERIES)


def test_coverage_has_no_gaps():
    text = open(os.path.join(ROOT, "COVERAGE.md"), encoding="utf-8").read()
    rows = re.findall(r"^\| ([A-Z]{2,3}-\d+) \| [^|]* \| [^|]* \| ([^|]*) \| ([^|]*) \|$", text, re.M)
    assert len(rows) > 100
    # model calls need an external service
    assert {oid for oid, queries, _ in rows if queries.strip() == "-"} == {f"INF-{i}" for i in range(1, 7)}
    assert not [oid for oid, _, modules in rows if modules.strip() == "-"]
