"""Accuracy by question length: word counts, exact tertiles, bins, breakdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkgrade.functions import text as tx
from sparkgrade.functions.text import as_column

# Bin names in report order.
BINS = ["Short", "Medium", "Long"]


def item_lengths(dataset: DataFrame, question: Column | str, keys: Sequence[str] = ("split", "id")) -> DataFrame:
    """Key and word count of each item; the text itself goes no further."""
    return dataset.select(*keys, tx.word_count(question).alias("word_count"))


def tertile_thresholds(lengths: DataFrame) -> DataFrame:
    """One row: the order statistics at n/3 and 2(n/3).

    The rows are first counted per distinct length, so the running sum sees at most as
    many rows as there are different lengths, however large the table is. Fewer than
    three rows, or a short limit that is not below the medium one, is an error raised
    when the thresholds are read.
    """
    histogram = lengths.groupBy("word_count").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy("word_count"))
    every = W.partitionBy()
    third = F.floor(F.sum("n").over(every) / 3)
    running = histogram.select("word_count", upto.alias("upto"), third.alias("third"))
    limits = running.agg(
        F.min(F.when(F.col("upto") >= F.col("third"), F.col("word_count"))).alias("short_max"),
        F.min(F.when(F.col("upto") >= 2 * F.col("third"), F.col("word_count"))).alias("medium_max"),
        F.max("third").alias("third"),
    )
    usable = (F.coalesce("third", F.lit(0)) >= 1) & (F.col("short_max") < F.col("medium_max"))
    message = F.lit("length thresholds need three rows and short < medium")
    checked = F.when(usable, F.col("short_max")).otherwise(F.raise_error(message).cast("int"))
    return limits.select(checked.alias("short_max"), "medium_max")


def fixed_thresholds(lengths: DataFrame, short_max: int, medium_max: int) -> tuple[Column, Column]:
    if short_max >= medium_max:
        raise ValueError(f"expected short_max < medium_max, got {short_max} and {medium_max}")
    return F.lit(short_max), F.lit(medium_max)


def length_bin(count: Column | str, short_max: Column, medium_max: Column) -> Column:
    """Bin by threshold, so equal lengths share a bin and bins may differ in size."""
    count = as_column(count)
    return F.when(count <= short_max, "Short").when(count <= medium_max, "Medium").otherwise("Long")


def bin_order(name: Column | str) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BINS]), as_column(name)).cast("int")


def bin_label(name: Column | str, short_max: Column, medium_max: Column) -> Column:
    name = as_column(name)
    short, medium = short_max.cast("string"), medium_max.cast("string")
    above = (short_max + 1).cast("string")
    return (
        F.when(name == "Short", F.concat(F.lit("Short ($\\le "), short, F.lit("$ words)")))
        .when(name == "Medium", F.concat(F.lit("Medium ("), above, F.lit("--"), medium, F.lit(" words)")))
        .otherwise(F.concat(F.lit("Long ($>"), medium, F.lit("$ words)")))
    )


def with_bins(lengths: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Attach bins and both limits; the one-row threshold table enters as a scalar subquery."""
    limits = thresholds.select(F.struct("short_max", "medium_max").alias("limits")).scalar()
    return lengths.withColumn("_limits", limits).select(
        *lengths.columns,
        F.col("_limits.short_max").alias("short_max"),
        F.col("_limits.medium_max").alias("medium_max"),
        length_bin("word_count", F.col("_limits.short_max"), F.col("_limits.medium_max")).alias("length_bin"),
    )


def _spread_bins(per_owner: DataFrame, owner: Sequence[str], measures: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """One row per owner and bin, bins without rows included, from columns named ``measure_Bin``."""
    rows = F.array(*[
        F.struct(F.lit(b).alias("length_bin"), *[F.col(f"{m}_{b}").alias(m) for m in measures]) for b in BINS
    ])
    return per_owner.select(*owner, *extra, F.explode(rows).alias("r")).select(*owner, *extra, "r.*")


def bin_counts(binned: DataFrame) -> DataFrame:
    counts = binned.agg(*[F.count_if(F.col("length_bin") == b).alias(f"n_{b}") for b in BINS])
    return _spread_bins(counts, [], ["n"], [])


def length_breakdown(binned: DataFrame, evals: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Per model and bin: total, correct, accuracy, and the model's missing and extra ids.

    ``evals`` has ``model``, the keys and ``is_correct``, one row per model and item.
    Every model gets all three bins. Accuracy of an empty bin is NULL.
    """
    items = binned.select(*keys, "length_bin", F.lit(True).alias("known"))
    limits = binned.agg(F.first("short_max").alias("s"), F.first("medium_max").alias("m"), F.count("*").alias("n"))
    limits = limits.select(F.struct("s", "m", "n").alias("limits")).scalar()
    joined = evals.join(items, list(keys), "left")
    correct = F.coalesce("is_correct", F.lit(False))
    per_model = joined.groupBy("model").agg(
        *[F.count_if(F.col("length_bin") == b).alias(f"total_{b}") for b in BINS],
        *[F.count_if((F.col("length_bin") == b) & correct).alias(f"correct_{b}") for b in BINS],
        F.count_if("known").alias("matched"),
        F.count_if(F.col("known").isNull()).alias("extra_eval_count"),
    ).withColumn("_limits", limits)
    per_model = per_model.withColumn("missing_eval_count", F.col("_limits.n") - F.col("matched"))
    rows = _spread_bins(
        per_model, ["model"], ["total", "correct"], ["missing_eval_count", "extra_eval_count", "_limits"]
    )
    accuracy = F.try_divide("correct", "total")
    return rows.select(
        "model",
        "length_bin",
        bin_order("length_bin").alias("bin_order"),
        bin_label("length_bin", F.col("_limits.s"), F.col("_limits.m")).alias("bin_label"),
        "total",
        "correct",
        accuracy.alias("accuracy"),
        tx.percent_text(accuracy).alias("accuracy_pct"),
        "missing_eval_count",
        "extra_eval_count",
    )


def item_results(binned: DataFrame, evals: DataFrame, models: Sequence[str], keys: Sequence[str] = ("id",)) -> DataFrame:
    """One row per requested model and dataset item, missing evaluations included."""
    wanted = binned.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    seen = evals.select(
        "model", *keys, F.coalesce("is_correct", F.lit(False)).alias("is_correct"), "detail", F.lit(True).alias("_seen")
    )
    joined = wanted.join(seen, ["model", *keys], "left")
    return joined.withColumn(
        "detail", F.when(F.col("_seen"), F.col("detail")).otherwise("missing_rule_evaluation")
    ).drop("_seen", "short_max", "medium_max")
