"""Totals over call logs, and run entries per workflow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions import text as tx
from sparkgrade.operators.keys import last_per_key

TOKENS = [
    "usage_input_tokens", "usage_output_tokens", "usage_cache_creation_tokens", "usage_cache_read_tokens",
]
MEASURES = [
    "api_call_count", "success_count", "error_count", "total_input_tokens", "total_output_tokens",
    "total_cache_creation_tokens", "total_cache_read_tokens",
]


def usage_measures() -> list[Column]:
    """Aggregates over call-log rows; every call that did not succeed is an error."""
    success = F.col("status").eqNullSafe("success")
    sums = [
        F.sum(F.coalesce(F.col(t).try_cast("bigint"), F.lit(0))).alias(m)
        for t, m in zip(TOKENS, MEASURES[3:])
    ]
    return [
        F.count("*").alias("api_call_count"),
        F.count_if(success).alias("success_count"),
        F.count_if(~success).alias("error_count"),
        *sums,
    ]


def _named(calls: DataFrame) -> DataFrame:
    return calls.withColumns({
        c: F.coalesce(tx.blank_to_null(c), F.lit("unknown")) for c in ("model_requested", "operation")
    })


def usage_parts(calls: DataFrame, owner: Sequence[str] = ("run_id",)) -> DataFrame:
    """Finest-grain totals per owner, model and operation."""
    return _named(calls).groupBy(*owner, "model_requested", "operation").agg(*usage_measures())


def roll_usage(parts: DataFrame, owner: Sequence[str] = ("run_id",)) -> DataFrame:
    """Totals per owner, per owner and model, per owner and operation, from finest-grain totals."""
    level = F.when(F.grouping("model_requested") == 0, "model").when(
        F.grouping("operation") == 0, "operation"
    ).otherwise("total")
    rolled = parts.groupingSets(
        [[*owner, "model_requested"], [*owner, "operation"], list(owner)], *owner, "model_requested", "operation"
    ).agg(level.alias("level"), *[F.sum(m).alias(m) for m in MEASURES])
    return rolled.select(
        *owner, "level", F.coalesce("model_requested", "operation", F.lit("")).alias("name"), *MEASURES
    )


def usage_totals(calls: DataFrame, owner: Sequence[str] = ("run_id",)) -> DataFrame:
    return roll_usage(usage_parts(calls, owner), owner)


def run_entries(runs: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Latest entry of each run; sort by ``workflow_id, started_at`` at the sink."""
    return last_per_key(runs, ["workflow_id", "run_id"], order)


def workflow_manifest(entries: DataFrame) -> DataFrame:
    """One row per workflow: its runs, how many succeeded, and its time span."""
    return entries.groupBy("workflow_id").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == "success").alias("successful_runs"),
        F.min("started_at").alias("first_started_at"),
        F.max("ended_at").alias("last_ended_at"),
    )
