"""Refresh the plan table of PLANS.md: run every registered query at sf0.01 and count its final plan's nodes."""

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from panelscore.plans.catalog import QUERIES  # noqa: E402
from panelscore.session import build_session  # noqa: E402

HEAD = "| query | shuffles | broadcasts | reused | scans | joins | python |"


def shape(plan: str) -> list[str]:
    final = plan.split("== Initial Plan ==")[0]
    nodes = re.findall(r"(\w+)", "\n".join(re.findall(r"^[\s:|*+\-()\d]*(\w+)", final, re.M)))
    joins = sorted({n for n in nodes if n.endswith("Join")})
    python = any(re.search("Pandas|Arrow|Python", n) for n in nodes)
    count = lambda name: str(nodes.count(name))
    scans = str(sum(n in ("FileScan", "Scan") for n in nodes))
    return [count("Exchange"), count("BroadcastExchange"), count("ReusedExchange"), scans, ", ".join(joins) or "-", "yes" if python else ""]


def main() -> None:
    spark = build_session()
    rows = []
    for name, fn in QUERIES.items():
        df = fn(spark, "/root/testdata/sf0.01")
        df.collect()
        rows.append(f"| `{name}` | " + " | ".join(shape(df._jdf.queryExecution().executedPlan().toString())) + " |")
    path = os.path.join(ROOT, "PLANS.md")
    text = open(path, encoding="utf-8").read()
    at = text.index(HEAD)
    end = text.find("\n\n", at)
    table = "\n".join([HEAD, "| --- | --- | --- | --- | --- | --- | --- |", *rows])
    open(path, "w", encoding="utf-8").write(text[:at] + table + (text[end:] if end >= 0 else "\n"))
    print(len(rows), "queries")


if __name__ == "__main__":
    main()
