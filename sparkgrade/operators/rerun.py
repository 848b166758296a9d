"""Which rows to run again: by failure pattern, and by exhausted token budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions import text as tx
from sparkgrade.functions.order import natural_key
from sparkgrade.functions.text import MISSING, as_column
from sparkgrade.operators.keys import as_columns, first_named_split, last_per_key

# Details that call for a rerun.
FAILURE_PATTERNS = ["parse_failed", "json_prediction_invalid", "json_reference_invalid", "sympy_not_installed"]
# Fixed value: share of the token budget from which an answer counts as cut off.
MIN_TOKEN_RATIO = 0.98


def failed_by_pattern(detail: Column | str, patterns: Sequence[str] = FAILURE_PATTERNS) -> Column:
    low = F.lower(F.coalesce(as_column(detail), F.lit("")))
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | F.contains(low, F.lit(pattern.lower()))
    return hit


def rerun_by_pattern(
    evals: DataFrame, manual: DataFrame | None = None, patterns: Sequence[str] = FAILURE_PATTERNS, pos: Sequence[Column | str] = ("_pos",)
) -> DataFrame:
    """Ids of failed rows plus a manual list, each once with its first named split."""
    failed = evals.filter(failed_by_pattern("detail", patterns)).select(
        "split", F.trim("id").alias("id"), F.struct(*as_columns(pos)).alias("_at"), F.lit(0).alias("_list")
    ).filter("id != ''")
    if manual is not None:
        listed = manual.select(F.lit("").alias("split"), F.col("id"), F.lit(1).alias("_list"))
        failed = failed.unionByName(listed, allowMissingColumns=True)
    return first_named_split(failed, ["_list", "_at"]).select("split", "id")


def missing_final_answer(response: Column | str, boxed: Column | str, final: Column | str) -> Column:
    empty = tx.blank_to_null(response).isNull()
    return (
        empty
        | F.coalesce(tx.strip(boxed) == MISSING, F.lit(False))
        | F.coalesce(tx.strip(final) == MISSING, F.lit(False))
    )


def token_threshold(budget: Column, ratio: float = MIN_TOKEN_RATIO, absolute: int | None = None) -> Column:
    """Tokens from which an answer is near its limit; an absolute number overrides the ratio."""
    if absolute is not None:
        return F.lit(absolute).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(budget.cast("double") * F.lit(ratio)).cast("bigint"))


def solve_calls(calls: DataFrame) -> DataFrame:
    """Successful answer calls with a question id. Stage, operation and status filters reach the scan."""
    return calls.filter(
        (F.col("stage") == "generate") & (F.col("operation") == "generate_solve") & (F.col("status") == "success")
    ).filter(tx.blank_to_null("question_id").isNotNull())


def latest_calls(calls: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Latest call per key in date, file and line order."""
    return last_per_key(calls, keys, order)


def attach_cost(
    rows: DataFrame, calls: DataFrame, order: Sequence[Column | str], fields: Sequence[str] = ("usage_output_tokens", "request_id", "timestamp_utc")
) -> DataFrame:
    """Add the call behind each row as struct ``cost``: same workflow, run and id, else same id."""
    def side(keys: Sequence[str], name: str) -> DataFrame:
        picked = latest_calls(calls, keys, order)
        return picked.select(*keys, F.struct(*fields).alias(name)).withColumnRenamed("question_id", "id")

    exact = side(["workflow_id", "run_id", "question_id"], "_exact")
    by_id = side(["question_id"], "_by_id")
    joined = rows.join(exact, ["workflow_id", "run_id", "id"], "left").join(by_id, "id", "left")
    return joined.withColumn("cost", F.coalesce("_exact", "_by_id")).drop("_exact", "_by_id")


def token_limit_status(rows: DataFrame, default_budget: int, ratio: float = MIN_TOKEN_RATIO, absolute: int | None = None) -> DataFrame:
    """Classify rows that went through :func:`attach_cost`.

    ``status`` is ``answered``, ``without_cost``, ``below_threshold`` or ``selected``.
    """
    budget = F.coalesce(F.col("max_solve_tokens").cast("string").try_cast("bigint"), F.lit(default_budget).cast("bigint"))
    used = F.col("cost.usage_output_tokens").cast("string").try_cast("bigint")
    out = rows.withColumns({
        "max_solve_tokens": budget,
        "usage_output_tokens": used,
        "threshold_tokens": token_threshold(budget, ratio, absolute),
    })
    missing = missing_final_answer("model_response", "answer_boxed", "final_answer_for_compare")
    return out.withColumn(
        "status",
        F.when(~missing, "answered")
        .when(F.col("usage_output_tokens").isNull(), "without_cost")
        .when(F.col("usage_output_tokens") < F.col("threshold_tokens"), "below_threshold")
        .otherwise("selected"),
    )


def token_limit_rows(classified: DataFrame) -> DataFrame:
    """The rows to rerun, with the columns of the report."""
    return classified.filter("status = 'selected'").select(
        "id", "split", "usage_output_tokens", "max_solve_tokens", "threshold_tokens", "workflow_id", "run_id",
        F.coalesce(F.col("cost.request_id").cast("string"), F.lit("")).alias("request_id"),
        F.coalesce(F.col("cost.timestamp_utc").cast("string"), F.lit("")).alias("timestamp_utc"),
        tx.blank_to_null("model_response").isNull().alias("model_response_empty"),
        tx.or_missing("answer_boxed").alias("answer_boxed"),
        tx.or_missing("final_answer_for_compare").alias("final_answer_for_compare"),
        F.lit("missing_final_answer_and_near_token_limit").alias("selection_reason"),
    )


def rerun_order() -> list[Column]:
    return [natural_key("split"), natural_key("id")]


def token_limit_funnel(classified: DataFrame, split: str = "split") -> DataFrame:
    """Rows scanned, without answer, without cost, below the threshold and selected."""
    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    parts = classified.groupBy(split).agg(
        F.count("*").alias("rows_scanned"),
        F.count_if(F.col("status") != "answered").alias("missing_answer_rows"),
        count("without_cost").alias("missing_without_cost"),
        count("below_threshold").alias("missing_below_threshold"),
        count("selected").alias("selected_rows"),
    )
    names = [c for c in parts.columns if c != split]
    return parts.rollup(split).agg(
        F.when(F.grouping(split) == 1, "overall").otherwise("split").alias("level"),
        *[F.sum(n).alias(n) for n in names],
    )
