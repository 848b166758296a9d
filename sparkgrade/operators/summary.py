"""Score tables: accuracy by model and split, groups, judge scores, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions import text as tx
from sparkgrade.functions.text import ratio


def _rolled(parts: DataFrame, owner: Sequence[str], detail: str, sums: Sequence[str]) -> DataFrame:
    """Add totals over ``detail`` to rows already summed at the finest grain.

    The facts are aggregated once; only those few partial rows are rolled up, so the
    fact table is never multiplied by the number of grouping levels.
    """
    return (
        parts.groupingSets([[*owner, detail], list(owner)], *owner, detail)
        .agg(
            F.when(F.grouping(detail) == 1, "overall").otherwise("split").alias("level"),
            *[F.sum(s).alias(s) for s in sums],
        )
    )


def accuracy_summary(
    evals: DataFrame, owner: Sequence[str] = ("model",), detail: str = "split"
) -> DataFrame:
    """Total, correct, accuracy, points and weighted accuracy per split and overall.

    A missing verdict counts as wrong; an empty total gives a ratio of 0.0.
    """
    correct = F.coalesce("is_correct", F.lit(False))
    parts = evals.groupBy(*owner, detail).agg(
        F.count("*").alias("total"),
        F.count_if(correct).alias("correct"),
        F.sum("points").alias("total_points"),
        F.sum("points_earned").alias("earned_points"),
    )
    rolled = _rolled(parts, owner, detail, ["total", "correct", "total_points", "earned_points"])
    return rolled.withColumns({
        "accuracy": ratio(F.col("correct"), F.col("total")),
        "weighted_accuracy": ratio(F.col("earned_points"), F.col("total_points")),
    })


def judge_summary(evals: DataFrame, owner: Sequence[str] = ("model", "judge_model"), detail: str = "split") -> DataFrame:
    """As :func:`accuracy_summary`, plus how often the reasoning was accepted."""
    parts = evals.groupBy(*owner, detail).agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("answer_correct", F.lit(False))).alias("correct"),
        F.count_if(F.coalesce("reasoning_correct", F.lit(False))).alias("reasoning_correct"),
        F.sum("points").alias("total_points"),
        F.sum("points_earned").alias("earned_points"),
    )
    sums = ["total", "correct", "reasoning_correct", "total_points", "earned_points"]
    return _rolled(parts, owner, detail, sums).withColumns({
        "accuracy": ratio(F.col("correct"), F.col("total")),
        "reasoning_accuracy": ratio(F.col("reasoning_correct"), F.col("total")),
        "weighted_accuracy": ratio(F.col("earned_points"), F.col("total_points")),
    })


def group_scores(evals: DataFrame, split: str = "split", group: str = "assignment_group") -> DataFrame:
    """Scores per assignment group inside each split, and per group over all splits.

    Ratios are recomputed from the added sums, so merging per-split scores and scoring
    the union give the same rows.
    """
    parts = evals.filter(F.col(group) != "").groupBy(split, group).agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("is_correct", F.lit(False))).alias("correct"),
        F.sum("points").alias("total_points"),
        F.sum("points_earned").alias("earned_points"),
    )
    return _rolled(parts, [group], split, ["total", "correct", "total_points", "earned_points"]).withColumns({
        "accuracy": ratio(F.col("correct"), F.col("total")),
        "weighted_accuracy": ratio(F.col("earned_points"), F.col("total_points")),
    })


def value_counts(df: DataFrame, owner: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """Count the values of several columns at once; blank values count as ``unknown``.

    The rows are first counted per combination, then those counts are unpivoted.
    """
    named = {d: F.coalesce(tx.blank_to_null(F.col(d).cast("string")), F.lit("unknown")) for d in dimensions}
    combos = df.withColumns(named).groupBy(*owner, *dimensions).agg(F.count("*").alias("n"))
    long = combos.select(
        *owner,
        "n",
        F.explode(F.map_from_arrays(
            F.array(*[F.lit(d) for d in dimensions]), F.array(*[F.col(d) for d in dimensions])
        )).alias("dimension", "value"),
    )
    return long.groupBy(*owner, "dimension", "value").agg(F.sum("n").alias("n"))


def top_counts(df: DataFrame, column: str, n: int, first_pos: Column) -> DataFrame:
    """The ``n`` most frequent values, ties in order of first appearance."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"), F.min(first_pos).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(n).drop("_first")


def label_balance(rows: DataFrame, owner: Sequence[str] = (), label: str = "label") -> DataFrame:
    """True, false and unknown labels among judge questions."""
    judged = rows.filter(F.lower(tx.strip("question_type")) == "judge")
    return judged.groupBy(*owner).agg(
        F.count("*").alias("judge_total"),
        F.count_if(F.col(label) == "True").alias("true"),
        F.count_if(F.col(label) == "False").alias("false"),
        F.count_if(F.col(label).isNull()).alias("unknown"),
    )


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows per split and stage, one column per stage."""
    names = list(stages)
    counts = [
        df.groupBy("split").agg(F.count("*").alias("n")).withColumn("stage", F.lit(name))
        for name, df in stages.items()
    ]
    tagged = counts[0]
    for more in counts[1:]:
        tagged = tagged.unionByName(more)
    return tagged.groupBy("split").pivot("stage", names).agg(F.sum("n")).na.fill(0, names)

