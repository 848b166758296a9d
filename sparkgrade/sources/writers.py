"""Writers: partitioned tables, JSON lines, CSV, id lists, backups, clones.

Tables are partitioned by their owner columns and overwritten dynamically, so writing
one model or split leaves the others alone. Before a partitioned write rows are
rebalanced: small partitions are merged into few files, a large split is spread over
several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrade.session import cut_lineage


def write_partitions(df: DataFrame, path: str, by: Sequence[str], format: str = "parquet") -> None:
    """Replace exactly the partitions ``df`` has rows for."""
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .format(format)
        .save(path)
    )


def append_rows(df: DataFrame, path: str, by: Sequence[str] = (), format: str = "parquet") -> None:
    df.write.mode("append").partitionBy(*by).format(format).save(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with a header and a fixed column list; other columns are dropped."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_ids(df: DataFrame, path: str, column: str = "id") -> None:
    """One id per line."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_summary_json(df: DataFrame, path: str) -> None:
    """A summary table as JSON lines."""
    df.write.mode("overwrite").json(path)


def update_partitions(new: DataFrame, path: str, by: Sequence[str], format: str = "parquet") -> None:
    """Replace partitions of the table ``new`` was computed from.

    The new rows are written aside first, so no task reads files its own job replaces.
    """
    write_partitions(cut_lineage(new, "update"), path, by, format)


def archive_calls(calls: DataFrame, path: str) -> None:
    """Keep call-log rows in a table partitioned by ``day``; each given day is replaced whole.

    Rows of a day are sorted by run, so that a query for one run skips most row groups.
    """
    rows = calls.drop("_pos").hint("rebalance", "day").sortWithinPartitions("day", "run_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def split_faults(staged: DataFrame, by: str = "split", key: str = "id") -> DataFrame:
    """Per split of ``staged``: its rows, and what is wrong with its keys (NULL: nothing)."""
    counts = staged.groupBy(by, key).agg(F.count("*").alias("n"))
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    sums = counts.groupBy(by).agg(
        F.sum("n").alias("rows"), F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank"),
        F.count_if(~blank & (F.col("n") > 1)).alias("repeated"),
    )
    fault = F.when(F.col("blank") > 0, F.concat(F.col("blank"), F.lit(" blank ids"))).when(
        F.col("repeated") > 0, F.concat(F.col("repeated"), F.lit(" repeated ids")))
    return sums.select(by, "rows", fault.alias("fault"))


def replace_split(
    spark: SparkSession, table: str, reviewed: DataFrame, backup: str, stamp: str, by: str = "split",
    key: str = "id", wanted: DataFrame | None = None,
) -> DataFrame:
    """Put reviewed splits in place of the stored ones, keeping a stamped backup.

    Write, audit, publish: the reviewed rows are staged, the staged copy is checked, and all
    splits that pass are published by one dynamic overwrite, their old rows backed up first. A
    split whose staged copy lacks rows, or has blank or repeated keys, stays as it is.

    Returns a report of the ``wanted`` splits (default: the reviewed ones): ``status`` applied,
    skipped or failed, the reason, and the staged rows. Without the column ``key`` only
    the rows are checked.
    """
    current = spark.read.parquet(table)
    staged = cut_lineage(reviewed, "staged")
    given = reviewed.groupBy(by).agg(F.count("*").alias("given"))
    audit = split_faults(staged, by, key) if key in staged.columns else staged.groupBy(by).agg(
        F.count("*").alias("rows"), F.lit(None).cast("string").alias("fault"))
    stored = current.select(by).distinct().withColumn("stored", F.lit(True))
    asked = (wanted if wanted is not None else staged).select(by).distinct()
    known = asked.join(given, by, "left").join(audit, by, "left").join(stored, by, "left")
    lacking = F.coalesce("rows", F.lit(0)) != F.col("given")
    reason = (
        F.when(F.col("given").isNull(), "no reviewed rows").when(F.col("stored").isNull(), "no stored rows")
        .when(lacking, "staged rows differ").otherwise(F.col("fault"))
    )
    status = F.when(reason.isNull(), "applied").when(F.col("given").isNull() | F.col("stored").isNull(), "skipped").otherwise("failed")
    report = cut_lineage(known.select(by, status.alias("status"), reason.alias("reason"), F.coalesce("rows", F.lit(0)).alias("rows")), "report")
    applied = report.filter("status = 'applied'").select(by)
    old = current.join(applied, by, "left_semi").withColumn("backup", F.lit(stamp))
    append_rows(old, backup, ["backup", by])
    # The staged copy is a table of its own, so no task reads files that its job replaces.
    write_partitions(staged.join(applied, by, "left_semi").select(*current.columns), table, [by])
    return report


def clone_artifact(
    spark: SparkSession, table: str, source: str, target: str, by: Sequence[str] = ("model", "split"), force: bool = False
) -> None:
    """Copy the answers of one artifact label to another.

    Equal labels, or a target that already has rows, are errors unless forced.
    """
    if source == target:
        raise ValueError("source and target label are equal")
    rows = spark.read.parquet(table)
    if not force and not rows.filter(F.col("model") == target).isEmpty():
        raise ValueError(f"{target} already has rows")
    copy = rows.filter(F.col("model") == source)
    if copy.isEmpty():
        raise ValueError(f"{source} has no rows")
    update_partitions(copy.withColumn("model", F.lit(target)), table, by)


def missing_splits(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Splits that still have to be produced."""
    return wanted.select("split").distinct().join(stored.select("split"), "split", "left_anti")


def write_stage_bundle(stages: dict[str, DataFrame], path: str) -> None:
    """All stage tables side by side, partitioned by stage and split.

    Rows stay rows: a split of any size is spread over files instead of being gathered
    into one document.
    """
    for name, df in stages.items():
        write_partitions(df.withColumn("stage", F.lit(name)), f"{path}/{name}", ["stage", "split"])
