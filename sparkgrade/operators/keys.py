"""Row selection by key and by order: dedupe, top-n, ranks, samples, id filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkgrade.functions import text as tx
from sparkgrade.session import cut_lineage


def as_columns(columns: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def spread(rows: DataFrame) -> DataFrame:
    """The same rows dealt out over all cores, for work that costs far more than moving them.

    A small file is read by one task however many rows it has, and so is what follows.
    """
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks)


def head_per_group(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key in the given order, numbered from 1 in ``row_number``.

    Spark trims every partition to ``n`` rows per key before the shuffle
    (``WindowGroupLimit``), so a key holding most of the table costs one task only
    ``n`` rows per upstream partition.
    """
    numbered = df.withColumn("row_number", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col("row_number") <= n)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Last row per key in file order. Rows with a blank key part must be filtered before."""
    latest = [c.desc() for c in as_columns(order)]
    return head_per_group(df, keys, latest, 1).drop("row_number")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return head_per_group(df, keys, [c.asc() for c in as_columns(order)], 1).drop("row_number")


def first_named_split(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """One row per id: the first one whose split is not blank, else the first one."""
    named = df.withColumn("split", F.coalesce(tx.blank_to_null("split"), F.lit("")))
    return head_per_group(
        named, ["id"], [F.col("split") == "", *[c.asc() for c in as_columns(order)]], 1
    ).drop("row_number")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str], shown: int = 10) -> DataFrame:
    """Raise when a key repeats, naming up to ``shown`` keys; else return ``df``."""
    repeated = duplicate_keys(df, keys).orderBy(*keys).limit(shown).collect()
    if repeated:
        names = ", ".join("/".join(str(row[k]) for k in keys) for row in repeated)
        raise ValueError(f"duplicate keys found: {names}")
    return df


def global_rank(df: DataFrame, order: Sequence[Column | str], rank: str = "rank") -> DataFrame:
    """Number all rows 1..n in a total order without moving them into one task.

    Rows are range-partitioned and sorted, written once, and numbered inside their
    partition; per-partition counts (one row per partition) give each its offset. The
    order must be total: rows with equal keys share a partition.
    """
    spark = df.sparkSession
    # Key expressions become columns first, or the sort would compute them per comparison.
    named = {f"_key{i}": key for i, key in enumerate(as_columns(order))}
    placed = (
        df.withColumns(named)
        .repartitionByRange(*named)
        .sortWithinPartitions(*named)
        .drop(*named)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed, "ranked")
    # The low 33 bits of the id count rows inside a partition, the rest name it.
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(rank, (F.col("_offset") + inside + 1).cast("bigint"))
        .drop("_part", "_offset", "_place")
    )


# Hex digits of the sampling hash that form a bucket: 16^5 buckets at most, so the
# bucket histogram stays small while each bucket holds about a millionth of the rows.
BUCKET_DIGITS = 5
# Rows of a sample that one task may hold.
MOST_TOP = 10_000


def sample_rows(df: DataFrame, n: int | Column, seed: int, ids: Sequence[Column | str]) -> DataFrame:
    """Exactly ``n`` rows (all, when fewer), chosen by a seeded hash of their ids.

    The choice does not depend on partitioning. Up to ``MOST_TOP`` rows are a bottom-k
    sketch: each task keeps its ``n`` smallest hashes, and those are merged, in one scan. For
    more, or a number known only while the query runs, a histogram of hash buckets finds the
    bucket where the ``n``-th smallest hash falls; whole buckets before it are taken
    and only that bucket is ordered.
    """
    key = F.md5(F.concat_ws(":", *[c.cast("string") for c in as_columns(ids)], F.lit(str(seed))))
    if isinstance(n, int) and n <= MOST_TOP:
        return df.withColumn("_key", key).orderBy("_key", *as_columns(ids)).limit(n).drop("_key")
    hashed = df.withColumn("_key", key).withColumn("_bucket", F.left("_key", F.lit(BUCKET_DIGITS)))
    wanted = n if isinstance(n, Column) else F.lit(n)
    histogram = hashed.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    running = histogram.withColumn("_upto", F.sum("_rows").over(W.orderBy("_bucket")))
    edge_row = running.filter(F.col("_upto") >= wanted).agg(
        F.min(F.struct("_bucket", (F.col("_upto") - F.col("_rows")).alias("before"))).alias("cut")
    )
    # One row, written so that the histogram is taken once for both parts below.
    cut = cut_lineage(edge_row, "cut").scalar()
    # No cut means there are fewer rows than wanted: every bucket is whole.
    whole = hashed.filter((F.col("_bucket") < cut["_bucket"]) | cut.isNull())
    edge = hashed.filter(F.col("_bucket") == cut["_bucket"])
    edge = edge.withColumn("_n", F.row_number().over(W.partitionBy("_bucket").orderBy("_key", *as_columns(ids))))
    edge = edge.filter(F.col("_n") <= wanted - cut["before"]).drop("_n")
    return whole.unionByName(edge).drop("_key", "_bucket")


def id_list(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame | None:
    """Distinct ids from inline text and / or a file, split on blanks and commas.

    ``None`` means "no filter was asked for" and keeps all rows; an empty file is an
    empty filter and keeps none.
    """
    parts = []
    if text:
        parts.append(spark.createDataFrame([(text,)], "value string"))
    if path is not None:
        parts.append(spark.read.text(path))
    if not parts:
        return None
    joined = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ids = joined.select(F.explode(F.split("value", r"[\s,]+")).alias("id"))
    return ids.filter("id != ''").distinct()


def keep_ids(df: DataFrame, ids: DataFrame | None, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Rows whose id is listed; ``None`` keeps all."""
    if ids is None:
        return df
    return df.join(ids.select(*keys).distinct(), list(keys), "left_semi")


def common_ids(evals: DataFrame, model: str = "model", key: str = "id") -> DataFrame:
    """Ids answered by every model: one aggregation, not one intersection per model."""
    answered = evals.select(key, model).distinct()
    models = answered.agg(F.count_distinct(model)).scalar()
    return answered.groupBy(key).agg(F.count("*").alias("models")).filter(F.col("models") == models).select(key)


def prefixes(text: Column, separator: str) -> Column:
    """The text itself and each part of it that ends right before a separator."""
    pieces = F.split(text, separator)
    return F.transform(
        F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), separator)
    )


def match_problems(df: DataFrame, selectors: DataFrame, number: str = "problem_number", key: str = "id") -> DataFrame:
    """Rows whose problem number or id equals a selector, or whose id lies below it.

    ``id = s OR id LIKE 's/%'`` becomes an equality with one of the id's own prefixes,
    so it runs as a hash or sort-merge join rather than a nested loop.
    """
    keys = F.array_append(prefixes(F.trim(key), "/"), F.trim(F.col(number).cast("string")))
    named = df.select(key, F.explode(F.array_distinct(keys)).alias("selector"))
    hits = named.join(selectors.select(F.trim("selector").alias("selector")), "selector", "left_semi")
    return df.join(hits.select(key).distinct(), key, "left_semi")


def members(df: DataFrame, column: str) -> Column:
    """The distinct values of a column of few values (splits, models) as a scalar array, so
    that rows are tested against them where they lie."""
    return df.agg(F.collect_set(column)).scalar()


def lookup(df: DataFrame, key: str, value: str) -> Column:
    """A small table as a scalar map from ``key`` to ``value``; keys must be unique."""
    return df.where(F.col(key).isNotNull()).agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()


def code_bits(codes: DataFrame, size: int) -> Column:
    """A bitmap of ``size`` (a power of two) places as a scalar array, in which the 64-bit hashes
    in the only column of ``codes`` are marked: with :func:`maybe_held`, rows that certainly
    match nothing are left out where they lie."""
    code = F.col(codes.columns[0])
    word = F.shiftright(code.bitwiseAND(F.lit(size - 1)), 6)
    held = codes.select(word.alias("id"), F.expr(f"shiftleft(1L, cast(`{codes.columns[0]}` & 63 AS int))").alias("bit"))
    held = held.groupBy("id").agg(F.bit_or("bit").alias("bits"))
    every = codes.sparkSession.range(size // 64).join(held, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))

    def in_order(at: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(at, "bits"))), lambda z: z["bits"])

    # Row by row of 4096 words, so that no aggregation sorts more than a few thousand.
    rows = every.groupBy(F.shiftright("id", 12).alias("row")).agg(in_order("id").alias("bits"))
    return rows.agg(in_order("row")).scalar()


def maybe_held(code: Column, bits: Column, size: int) -> Column:
    """Whether the bitmap has the place of a hash marked."""
    place = code.bitwiseAND(F.lit(size - 1))
    row = F.get(bits, F.shiftright(place, 18).cast("int"))
    word = F.get(row, F.shiftright(place, 6).bitwiseAND(F.lit(4095)).cast("int"))
    return F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1


def only_in(df: DataFrame, small: DataFrame, column: str) -> DataFrame:
    """Rows whose value of a column of few values occurs in ``small``."""
    return df.where(F.array_contains(members(small, column), F.col(column)))


def latest(df: DataFrame, keys: Sequence[str], pos: str | None = None) -> DataFrame:
    """The last row per key by ``pos``, by ``_pos`` if the table has it; a table without a
    row order must not repeat keys."""
    order = pos or ("_pos" if "_pos" in df.columns else None)
    return last_per_key(df, keys, [order]) if order else require_unique(df, keys)
