"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables.

    A temporary folder is used only where the setting is absent *and* the session
    is local (tests): executors on other machines could not read it.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="sparkgrade-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark would use for it, so that readers
    other than Spark open the same place."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def file_system(folder: str) -> tuple[Any, str]:
    """The file system of a qualified folder, for use inside tasks, and the path in it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return qualified(spark, f"{shared_folder(spark)}/sparkgrade/{name}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans made inside send Python functions so many rows at a time at most. Spark's 10,000 are
    tens of MB of long texts, several times over on both sides."""
    given = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(min(rows, int(given)) if int(given) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, given)


PACKED = "_texts"


def cut_lineage(df: DataFrame, name: str = "table", texts: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several consumers or must not be recomputed (scorer
    output, a range-partitioned order). Being an ordinary parquet table it survives
    lost executors, keeps column pruning, and gives the optimiser real sizes.

    ``texts`` are string columns that repeat long texts, of their own row or of the rows next to
    it. They are written as one array, so that repeats lie close together and compress away,
    and come back as the columns they were.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    if not texts:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    packed = df.select(*[c for c in df.columns if c not in texts], F.array(*texts).alias(PACKED))
    packed.write.option("compression", "zstd").parquet(path)
    place = {column: F.get(PACKED, F.lit(i)).alias(column) for i, column in enumerate(texts)}
    return spark.read.schema(packed.schema).parquet(path).select(*[place.get(c, c) for c in df.columns])
