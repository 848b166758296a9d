"""Table maintenance: pending and stale rows, pruning, upserts, replacements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions import text as tx
from sparkgrade.operators.keys import as_columns, members, prefixes


def pending_rows(dataset: DataFrame, done: DataFrame, keys: Sequence[str] = ("split", "id")) -> DataFrame:
    """Dataset rows that have no output yet."""
    return dataset.join(done.select(*keys), list(keys), "left_anti")


def stale_rows(output: DataFrame, dataset: DataFrame, keys: Sequence[str] = ("split", "id")) -> DataFrame:
    """Output rows whose item is no longer in the dataset."""
    return output.join(dataset.select(*keys), list(keys), "left_anti")


def prune_plan(artifacts: DataFrame, dataset: DataFrame) -> DataFrame:
    """Mark each artifact row ``kept`` or ``removed``.

    Rows with a blank id and rows of splits the dataset does not have are kept. The
    splits are a scalar list; ids come from a left join on distinct keys.
    """
    known_ids = dataset.select("split", "id").distinct().withColumn("_known", F.lit(True))
    splits = members(dataset, "split")
    blank = tx.blank_to_null("id").isNull()
    removed = F.array_contains(splits, F.col("split")) & F.col("_known").isNull() & ~blank
    return (
        artifacts.join(known_ids, ["split", "id"], "left")
        .withColumn("status", F.when(removed, "removed").otherwise("kept"))
        .drop("_known")
    )


def prune(artifacts: DataFrame, dataset: DataFrame) -> DataFrame:
    return prune_plan(artifacts, dataset).filter("status = 'kept'").drop("status")


def upsert_rows(
    existing: DataFrame,
    replacement: DataFrame,
    order: DataFrame | None = None,
    pos: Sequence[Column | str] = ("_pos",),
    keep_blank_ids: bool = True,
    keys: Sequence[str] = ("id",),
) -> DataFrame:
    """Merge two versions of a table; the replacement wins, the last of repeated rows wins.

    Adds ``_side`` and ``_place``: ids of ``order`` (``id`` and ``_rank``) come first in
    its order (side 0), then other existing rows (1), then other new rows (2), each at
    its first position. Rows with a blank id never meet a shuffle on the id, where they
    would all land in one task.
    """
    fields = existing.columns
    place = F.struct(*as_columns(pos))

    def tagged(df: DataFrame, side: int) -> DataFrame:
        return df.select(
            *keys, F.struct(*fields).alias("_row"), F.lit(side).alias("_from"), place.alias("_place")
        )

    both = tagged(existing, 1).unionByName(tagged(replacement.select(*fields), 2))
    has_id = F.lit(True)
    for key in keys:
        has_id = has_id & tx.blank_to_null(F.col(key).cast("string")).isNotNull()
    merged = both.filter(has_id).groupBy(*keys).agg(
        F.max_by("_row", F.struct("_from", "_place")).alias("_row"),
        F.min(F.struct("_from", "_place")).alias("_first"),
    ).select(*keys, "_row", F.col("_first._from").alias("_side"), F.col("_first._place").alias("_place"))
    if order is not None:
        ranked = order.groupBy(*keys).agg(F.min("_rank").alias("_rank"))
        merged = merged.join(ranked, list(keys), "left").withColumn(
            "_side", F.when(F.col("_rank").isNotNull(), 0).otherwise(F.col("_side"))
        )
    else:
        merged = merged.withColumn("_rank", F.lit(None).cast("bigint"))
    out = merged.select("_row.*", "_side", "_rank", "_place")
    if keep_blank_ids:
        blank = both.filter(~has_id).select(
            "_row.*", F.col("_from").alias("_side"), F.lit(None).cast("bigint").alias("_rank"), "_place"
        )
        out = out.unionByName(blank)
    return out


def upsert_order() -> list[Column]:
    """Sort columns that put the result of :func:`upsert_rows` in output order."""
    return [F.col("_side"), F.col("_rank"), F.col("_place")]


def replace_by_base(existing: DataFrame, updated: DataFrame, bases: DataFrame) -> DataFrame:
    """Drop rows whose id is a base or ``base#...``, then append the updated rows."""
    named = existing.select("id", F.explode(prefixes(F.trim("id"), "#")).alias("base"))
    hit = named.join(bases.select(F.trim("base").alias("base")), "base", "left_semi").select("id").distinct()
    return existing.join(hit, "id", "left_anti").unionByName(updated, allowMissingColumns=True)


def id_difference(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Keys on one side only, marked ``missing`` (left only) or ``extra`` (right only)."""
    lhs = left.select(*keys, F.lit(1).alias("_left"), F.lit(0).alias("_right"))
    rhs = right.select(*keys, F.lit(0).alias("_left"), F.lit(1).alias("_right"))
    sides = lhs.unionByName(rhs).groupBy(*keys).agg(F.max("_left").alias("l"), F.max("_right").alias("r"))
    return sides.filter("l + r = 1").select(
        *keys, F.when(F.col("l") == 1, "missing").otherwise("extra").alias("side")
    )


def paired_update(
    final: DataFrame, stage: DataFrame, updates: dict[str, str], keys: Sequence[str] = ("split", "id")
) -> DataFrame:
    """Copy stage columns into final rows with the same key.

    ``updates`` maps a final column to the stage column that replaces it. Adds
    ``targeted`` (a stage row exists) and ``changed`` (some value differs).
    """
    source = stage.select(*keys, *[F.col(s).alias(f"_new_{f}") for f, s in updates.items()])
    source = source.withColumn("targeted", F.lit(True))
    joined = final.join(source, list(keys), "left").withColumn(
        "targeted", F.coalesce("targeted", F.lit(False))
    )
    differs = F.lit(False)
    for column in updates:
        differs = differs | ~F.col(f"_new_{column}").eqNullSafe(F.col(column))
    joined = joined.withColumn("changed", F.col("targeted") & differs)
    for column in updates:
        new = F.when(F.col("targeted"), F.col(f"_new_{column}")).otherwise(F.col(column))
        joined = joined.withColumn(column, new)
    return joined.drop(*[f"_new_{c}" for c in updates])


def paired_update_counts(updated: DataFrame, stage: DataFrame, final: DataFrame, keys: Sequence[str] = ("split", "id")) -> DataFrame:
    """Per split: stage rows targeted, final rows changed, stage rows without a final row."""
    changed = updated.groupBy("split").agg(
        F.count_if("targeted").alias("matched"), F.count_if("changed").alias("changed")
    )
    gone = stage.join(final.select(*keys), list(keys), "left_anti").groupBy("split").agg(
        F.count("*").alias("missing")
    )
    wanted = stage.groupBy("split").agg(F.count("*").alias("targeted"))
    return wanted.join(changed, "split", "left").join(gone, "split", "left").na.fill(0)


def drop_evaluations(evals: DataFrame, invalid: DataFrame, keys: Sequence[str] = ("split", "id")) -> DataFrame:
    """Derived rows that stay valid after the answers of ``invalid`` ids changed."""
    return evals.join(invalid.select(*keys).distinct(), list(keys), "left_anti")
