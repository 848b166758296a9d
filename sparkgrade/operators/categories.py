"""Accuracy by problem category and model family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkgrade.functions.text import as_column
from sparkgrade.operators.keys import head_per_group

# Problem categories in report order, and their short names.
CATEGORIES = {
    "Pure Math / Basic Calculation": "Basic Math",
    "Simple Math but Requires Economics Concepts": "Conceptual Econ Math",
    "Model-Based, Medium Difficulty": "Model Based Medium",
    "Advanced / Hardest Model Problems": "Model Based Advanced",
}

# Effort levels from low to high.
EFFORT_RANK = {"default": 0, "medium": 1, "high": 2, "max": 3, "xhigh": 4}


def category_rank(label: Column | str, order: Sequence[str] = tuple(CATEGORIES)) -> Column:
    """Position in the fixed order, from 1; NULL for a label outside it."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), as_column(label))
    return F.nullif(place, F.lit(0)).cast("int")


def effort_rank(effort: Column | str) -> Column:
    rank = F.lit(-1)
    for name, value in EFFORT_RANK.items():
        rank = F.when(as_column(effort) == name, value).otherwise(rank)
    return rank


def known_labels(labels: DataFrame, order: Sequence[str] = tuple(CATEGORIES), label: str = "label") -> DataFrame:
    return labels.filter(F.col(label).isin(list(order)))


def representative_configs(configs: DataFrame, api_families: Sequence[str] | None = None) -> DataFrame:
    """Best configuration per family and effort: largest budget, then name.

    ``configs`` has ``family, effort, max_tokens, model``. Families outside
    ``api_families`` keep every configuration; ``None`` applies the rule to all.
    """
    distinct = configs.select("family", "effort", "max_tokens", "model").distinct()
    ruled = distinct if api_families is None else distinct.filter(F.col("family").isin(list(api_families)))
    best = head_per_group(
        ruled, ["family", "effort"], [F.desc("max_tokens"), F.asc("model")], 1
    ).drop("row_number")
    if api_families is None:
        return best
    return best.unionByName(distinct.filter(~F.col("family").isin(list(api_families))))


def category_accuracy(
    evals: DataFrame,
    labels: DataFrame,
    owner: Sequence[str] = ("family", "variant", "model"),
    key: str = "id",
    label: str = "label",
) -> DataFrame:
    """Total, correct and percent per configuration and category, plus its overall percent."""
    merged = evals.join(labels.select(key, label), key)
    counts = merged.groupBy(*owner, label).agg(
        F.count("*").alias("total"), F.count_if(F.coalesce("is_correct", F.lit(False))).alias("correct")
    )
    # The window runs over the counted rows, a handful per configuration.
    whole = W.partitionBy(*owner)
    return counts.withColumns({
        "accuracy_pct": F.col("correct") / F.col("total") * 100.0,
        "overall_accuracy_pct": F.sum("correct").over(whole) / F.sum("total").over(whole) * 100.0,
    })


def macro_accuracy(accuracy: DataFrame, owner: Sequence[str] = ("family", "variant"), label: str = "label") -> DataFrame:
    """Unweighted mean of the configurations' percentages."""
    return accuracy.groupBy(*owner, label).agg(
        F.avg("accuracy_pct").alias("macro_accuracy_pct"), F.count("*").alias("configs")
    )


def category_counts(labels: DataFrame, order: Sequence[str] = tuple(CATEGORIES), label: str = "label") -> DataFrame:
    """Items per category in fixed order, categories without items included."""
    counts = labels.agg(*[F.count_if(F.col(label) == c).alias(f"c{i}") for i, c in enumerate(order)])
    rows = F.array(*[
        F.struct(F.lit(c).alias(label), F.lit(i + 1).alias("rank"), F.col(f"c{i}").alias("n"))
        for i, c in enumerate(order)
    ])
    return counts.select(F.explode(rows).alias("r")).select("r.*")
