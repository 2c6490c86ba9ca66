"""Prompt x model fan-out and round-robin judge pairing (JN-1, JN-2, FLT-3, JN-8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.panel import check_panel, others, panel_array


def fan_out(prompts: DataFrame, models: Sequence[str], selected: Sequence[str] | None = None) -> DataFrame:
    """One row per prompt x selected model, adding ``model`` and ``model_idx``.

    The model selection is applied *here*, before any model is called, so
    deselected models cost nothing (an empty or absent selection means all).
    """
    models = check_panel(models)
    if selected:
        unknown = set(selected) - set(models)
        if unknown:
            raise ValueError(f"selected models not in panel: {sorted(unknown)}")
    cols = [c for c in prompts.columns]
    return prompts.select(*cols, F.inline(panel_array(models, selected))).withColumnRenamed(
        "i", "model_idx"
    )


def judge_pairs(
    targets: DataFrame,
    models: Sequence[str],
    selected: Sequence[str] | None = None,
    panel: str = "all",
) -> DataFrame:
    """Every target row (column ``model``) x each *other* judge of the panel.

    ``panel='all'`` lets every panel member judge (the protocol's code path);
    ``panel='selected'`` restricts judges to the selected models. The target
    column is renamed ``target_model``; ``evaluator`` and ``evaluator_idx`` are
    added. A self pair never occurs and rows stay in place (no shuffle).
    """
    if panel not in ("all", "selected"):
        raise ValueError("panel must be 'all' or 'selected'")
    judges = panel_array(models, selected if panel == "selected" else None)
    t = targets.withColumnRenamed("model", "target_model")
    return (
        t.select("*", F.inline(others(judges, F.col("target_model"))))
        .withColumnRenamed("i", "evaluator_idx")
        .withColumnRenamed("model", "evaluator")
    )
