"""Provenance columns of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stamp(
    rows: DataFrame, stage: str, solver_model: str, judge_model: str = "", workflow_id: str = "", run_id: str = ""
) -> DataFrame:
    """Add who produced a row, in which run and when."""
    return rows.withColumns({
        "workflow_id": F.lit(workflow_id),
        "run_id": F.lit(run_id),
        "stage": F.lit(stage),
        "solver_model": F.lit(solver_model),
        "judge_model": F.lit(judge_model),
        "question_id": F.col("id"),
        "created_at": F.current_timestamp(),
    })
