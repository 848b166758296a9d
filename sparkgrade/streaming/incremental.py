"""Rows processed as they arrive, each exactly once, resuming where a run stopped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fresh_rows(source: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Of a stream, the rows whose key no earlier batch had, one a key.

    What was seen is keyed state in the checkpoint. Without ``order`` it is the keys alone and
    any row of a batch stands for its key. With ``order`` the last row of the batch does; the
    state then holds that row and the time of the batch that brought the key, which is the
    time of the present batch for new keys only.
    """
    if not order:
        return source.dropDuplicates(list(keys))
    # The current time is one value a batch, and the same when the batch is replayed.
    rows = source.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.struct(*order).alias("_order"), F.struct(*source.columns).alias("_row"),
        F.current_timestamp().alias("_now"),
    )
    seen = rows.groupBy(*[f"_{k}" for k in keys]).agg(F.max_by("_row", "_order").alias("_row"), F.min("_now").alias("_since"))
    return seen.where(F.col("_since") == F.current_timestamp()).select("_row.*")


def process_new_rows(
    source: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    keys: Sequence[str] = ("split", "id"),
    order: Sequence[str] = (),
    once: bool = True,
) -> StreamingQuery:
    """Apply ``process`` to arriving rows whose key has no result yet and store the result.

    The stream's own state tells what is done, so a batch reads its new rows and nothing that
    was stored. Each batch fills its own partition; one that is replayed after a failure
    chooses the same rows and replaces its partition. Of rows that repeat inside a batch the
    last by ``order`` counts. A new checkpoint forgets what was done.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    fresh = fresh_rows(source, keys, order)
    writer = fresh.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()
