"""Running usage totals over a growing call log."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkgrade.operators.usage_totals import MEASURES, usage_parts
from sparkgrade.session import cut_lineage
from sparkgrade.sources.writers import write_partitions

BUCKETS = 16


def stream_totals(calls: DataFrame, owner: Sequence[str] = ("run_id",)) -> DataFrame:
    """Streaming totals per owner, model and operation.

    State is one small row per combination and lives in the checkpoint. Roll the stored
    table up with :func:`sparkgrade.operators.usage_totals.roll_usage` when reading.
    """
    return usage_parts(calls, owner)


def store_totals(changed: DataFrame, path: str, owner: Sequence[str], buckets: int = BUCKETS) -> None:
    """Put changed totals in place of the stored ones.

    The table is partitioned by a hash of the owner. Only the buckets that ``changed`` touches
    are read and overwritten; storing the same totals again changes nothing.
    """
    spark = changed.sparkSession
    bucket = F.pmod(F.xxhash64(*owner), F.lit(buckets)).cast("int").alias("bucket")
    changed = cut_lineage(changed.select("*", bucket), "changed-totals")
    touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # no more than there are buckets
    if not touched:
        return
    names = [c for c in changed.columns if c not in (*MEASURES, "bucket")]
    rows = changed
    try:
        stored = spark.read.schema(changed.schema).parquet(path).where(F.col("bucket").isin(touched))
        new = changed.select(*[F.col(n).alias(f"_{n}") for n in names])
        same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
        rows = changed.unionByName(stored.join(new, same, "left_anti"))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    # A dynamic overwrite replaces partitions when its job commits, after all reads.
    write_partitions(rows, path, ["bucket"])


def write_totals(
    calls: DataFrame, path: str, checkpoint: str, owner: Sequence[str] = ("run_id",), once: bool = True, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep the current totals in a table, whose size is that of the totals however many
    batches ran. ``buckets`` must stay the same for one table.

    A batch that is replayed after a failure stores the same totals again. ``once`` takes what
    is there and stops.
    """
    writer = (
        stream_totals(calls, owner)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: store_totals(batch, path, owner, buckets))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_totals(spark: SparkSession, path: str) -> DataFrame:
    """The stored totals, one row per combination."""
    return spark.read.parquet(path).drop("bucket")
