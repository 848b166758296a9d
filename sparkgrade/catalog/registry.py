"""Registration of catalogue queries with their SQL twins, and table access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# White space of any kind, for the SQL twins (their \s is ASCII only).
WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as the query of the same name, ``sql`` as its oracle."""
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text(column: str) -> Column:
    return F.col(column).cast("string")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as evaluation items: id, split = language, chapter = source."""
    return table(spark, folder, "documents").select(
        text("doc_id").alias("id"), F.col("lang").alias("split"), F.col("source").alias("chapter"),
        F.col("text").alias("question_final"), F.col("doc_id").alias("_pos"),
    )


def label_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as verdicts of two graders: ``model`` is ``quality`` or ``toxic``."""
    labels = table(spark, folder, "labels")
    return labels.select(
        text("doc_id").alias("id"),
        F.explode(F.array(
            F.struct(F.lit("quality").alias("model"), (F.col("quality") == 1).alias("is_correct")),
            F.struct(F.lit("toxic").alias("model"), (F.col("toxic") == 0).alias("is_correct")),
        )).alias("v"),
    ).select("v.model", "id", "v.is_correct")


def everything(column: str) -> Column:
    """Rollup level as text: the group's value, or ALL for the total."""
    return F.coalesce(column, F.lit("ALL"))
