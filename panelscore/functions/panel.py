"""Column helpers for a model panel passed as a small, bounded parameter.

A panel is a handful of model names. Instead of joining a panel table (a cross
join), rows are fanned out with ``explode`` over a literal array: a narrow,
shuffle-free Generate that stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_panel(models: Sequence[str], max_panel: int | None = None) -> list[str]:
    """Distinct, non-empty panel; ``max_panel`` is an optional guard of the caller."""
    models = list(models)
    if not models:
        raise ValueError("empty model panel")
    if len(set(models)) != len(models):
        raise ValueError("panel names must be distinct")
    if max_panel is not None and len(models) > max_panel:
        raise ValueError(f"panel must be at most {max_panel} names")
    return models


def panel_array(models: Sequence[str], keep: Sequence[str] | None = None) -> Column:
    """array<struct<i:int, model:string>>; ``i`` is the position in the full panel."""
    models = check_panel(models)
    chosen = [(i, m) for i, m in enumerate(models) if not keep or m in set(keep)]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("model")) for i, m in chosen])


def others(models_col: Column, model_col: Column) -> Column:
    """Panel entries other than ``model_col`` (the round-robin judges of a target)."""
    return F.filter(models_col, lambda e: e["model"] != model_col)
