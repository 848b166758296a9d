"""Readers: JSON-lines tables, split folders, source trees, reviews, logs, layers.

Schemas are always given, never inferred. Every reader that must keep file order adds
``_pos``, a struct that sorts rows as they stand in their files: path, block, and a row
number that grows inside a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrade import schemas
from sparkgrade.functions import labels as lb
from sparkgrade.functions import text as tx
from sparkgrade.operators.keys import duplicate_keys, last_per_key, only_in, require_unique
from sparkgrade.operators.overlay import review_entries
from sparkgrade.session import cut_lineage


def position() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def file_stem() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def _or_empty(spark: SparkSession, read, schema_of: str) -> DataFrame:
    """What ``read`` returns, or an empty table when the path does not exist."""
    try:
        return read()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema_of)


POSITION = "_pos struct<path: string, block: bigint, row: bigint>"


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON-lines table in file order; blank lines are skipped, a bad line is an error."""
    def read() -> DataFrame:
        rows = spark.read.schema(schemas.struct(ddl)).option("mode", "FAILFAST").json(path)
        return rows.withColumn("_pos", position())

    return _or_empty(spark, read, f"{ddl}, {POSITION}")


def read_documents(spark: SparkSession, path: str, ddl: str, tolerant: bool = False) -> DataFrame:
    """One row per whole-file JSON document, with ``path`` and ``stem``.

    ``tolerant`` drops unreadable files instead of failing.
    """
    schema = schemas.struct(ddl)
    bad = "_bad_document"
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    if tolerant:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
        schema = schemas.struct(f"{ddl}, {bad} STRING")
    else:
        reader = reader.option("mode", "FAILFAST")
    rows = reader.schema(schema).json(path)
    rows = rows.withColumns({"path": F.col("_metadata.file_path"), "stem": file_stem()})
    return rows.filter(F.col(bad).isNull()).drop(bad) if tolerant else rows


def read_splits(spark: SparkSession, folder: str, ddl: str, split: str | None = None) -> DataFrame:
    """Every ``*.jsonl`` of a folder as one table with column ``split`` = file stem.

    Balanced review copies are left out unless named. A named split prunes the listing
    itself, so other files are not opened.
    """
    fields = [f for f in schemas.struct(ddl).fields if f.name != "split"]
    schema = schemas.struct(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
    rows = (
        spark.read.schema(schema)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", f"{split}.jsonl" if split else "*.jsonl")
        .json(folder)
        .withColumns({"split": file_stem(), "_pos": position()})
    )
    return rows if split else rows.filter(~F.endswith("split", F.lit("_balanced")))


def read_problem_files(spark: SparkSession, root: str) -> DataFrame:
    """Problem files ``<chapter>/out_split/<problem>/<sub>.json`` of a source tree."""
    return _problem_documents(spark, root, r"^(.+)/out_split/([^/]+)/([^/]+)\.json$", ["chapter", "folder", "stem"])


def read_parent_files(spark: SparkSession, root: str) -> DataFrame:
    """Parent problems ``<chapter>/by_problem/<file>``."""
    return _problem_documents(spark, root, r"^(.+)/by_problem/([^/]+\.json)$", ["chapter", "file"])


def _problem_documents(spark: SparkSession, root: str, pattern: str, names: Sequence[str]) -> DataFrame:
    fields = schemas.PROBLEM_FIELDS
    nested = schemas.struct(fields).simpleString()
    docs = read_documents(spark, root, f"{fields}, problem {nested}").drop("stem")
    relative = relative_path(F.col("path"), root)
    docs = docs.filter(relative.rlike(pattern))
    for i, name in enumerate(names, start=1):
        docs = docs.withColumn(name, F.regexp_extract(relative, pattern, i))
    # A file holds the problem itself, or an object with the problem inside.
    for field in schemas.struct(fields).fieldNames():
        docs = docs.withColumn(
            field, F.when(F.col("problem").isNotNull(), F.col(f"problem.{field}")).otherwise(F.col(field))
        )
    return docs.drop("problem")


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``, whatever scheme the file system puts in front."""
    bare = "/" + root.split("://")[-1].strip("/") + "/"
    return F.substring_index(F.regexp_replace(path, "^[a-z0-9]+:/*", "/"), bare, -1)


def read_reviews(spark: SparkSession, root: str) -> DataFrame:
    """Latest reviewer entry per (split, id) from ``<annotator>/<split>.json`` files."""
    docs = read_documents(spark, root, schemas.REVIEW, tolerant=True)
    return review_entries(docs.withColumn("split", F.col("stem")))


def read_call_log(spark: SparkSession, root: str, days: Sequence[str] = (), runs: Sequence[str] = ()) -> DataFrame:
    """Call log ``<day>/<run>.jsonl`` in date, file and line order by ``_pos``, with ``day`` from
    the folder. Named days and runs are all that is listed and opened; days or runs without
    a log have no rows."""
    def among(names: Sequence[str]) -> str:
        return "{" + ",".join(names) + "}" if names else "*"

    def read() -> DataFrame:
        rows = spark.read.schema(schemas.struct(schemas.CALL_LOG)).option("mode", "FAILFAST").json(f"{root}/{among(days)}/{among(runs)}.jsonl")
        day = F.to_date(F.element_at(F.split("_metadata.file_path", "/"), -2))
        return rows.withColumns({"_pos": position(), "date": F.to_date("timestamp_utc"), "day": day})

    return _or_empty(spark, read, f"{schemas.CALL_LOG}, {POSITION}, date date, day date")


def read_archived_calls(spark: SparkSession, path: str, days: DataFrame | None = None) -> DataFrame:
    """Calls of the table that ``writers.archive_calls`` keeps; ``days`` (day) prunes its
    partitions while the query runs."""
    calls = spark.read.schema(schemas.struct(f"{schemas.CALL_LOG}, date DATE, day DATE")).parquet(path)
    return calls if days is None else calls.join(days.select("day").distinct(), "day", "left_semi")


def latest_by_id(rows: DataFrame, key: str = "id", pos: str = "_pos", other: str = "question_id") -> DataFrame:
    """Last row per non-blank id in file order; where the id is blank, ``other`` is the id."""
    given = [F.trim(c) for c in (key, other) if c in rows.columns]
    named = rows.withColumn(key, F.coalesce(*[tx.blank_to_null(c) for c in given])).filter(F.col(key).isNotNull())
    return last_per_key(named, [key], [pos])


def resolve_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Find the source of each item: its recorded path, else the path its ids imply.

    ``items`` has ``source_path, chapter, problem_number, sub_id``; ``sources`` has
    ``source_key`` (path below the chapters folder) and ``source``. Both candidate paths
    are plain join keys; ``source`` is NULL where neither exists.
    """
    # Fixed value: the folder below which a recorded path is meaningful elsewhere too.
    recorded = F.substring_index(F.trim("source_path"), "datasets/chapters/", -1)
    sub = F.coalesce(tx.blank_to_null("sub_id"), F.lit("main"))
    leaf = F.when(F.endswith(sub, F.lit(".json")), sub).otherwise(F.concat(sub, F.lit(".json")))

    def implied(file: Column) -> Column:
        return F.concat_ws("/", "chapter", F.lit("out_split"), "problem_number", file)

    candidates = {"_recorded": recorded, "_implied": implied(leaf), "_main": implied(F.lit("main.json"))}
    rows = items.withColumns(candidates)
    for name in candidates:
        found = sources.select(F.col("source_key").alias(name), F.col("source").alias(f"{name}_source"))
        rows = rows.join(found, name, "left")
    found = F.coalesce(*[F.col(f"{n}_source") for n in candidates])
    return rows.withColumn("source", found).drop(*candidates, *[f"{n}_source" for n in candidates])


# An owner with more than one row in so many is decided where its rows lie. There are fewer
# such owners than this, whatever the size of the layers.
HEAVY_OWNERS = 1000


def layered(layers: Sequence[DataFrame], owner: Sequence[str] = ("model", "split")) -> DataFrame:
    """Rows of the first layer that has anything for a (model, split).

    The winning layers are one aggregate, written once. Rows of an owner that holds more than
    a thousandth of all rows meet their winner in a broadcast of those few owners and are never
    shuffled; rows of all other owners meet theirs in a shuffle join without a heavy key.
    """
    tagged = [df.withColumn("_layer", F.lit(i)) for i, df in enumerate(layers)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    winners = rows.groupBy(*[F.col(o).alias(f"_{o}") for o in owner]).agg(
        F.min("_layer").alias("_first"), F.count("*").alias("_rows"))
    winners = cut_lineage(winners, "layer-winners")
    heavy_from = winners.agg(F.sum("_rows") / HEAVY_OWNERS).scalar()
    heavy = F.broadcast(winners.where(F.col("_rows") > heavy_from))
    light = winners.where(F.col("_rows") <= heavy_from)
    same_owner = reduce(lambda a, b: a & b, [F.col(o).eqNullSafe(F.col(f"_{o}")) for o in owner])
    first = same_owner & (F.col("_layer") == F.col("_first"))
    lying = rows.join(heavy, first, "left_semi")
    moved = rows.join(heavy, same_owner, "left_anti").join(light, first, "left_semi")
    return lying.unionByName(moved).drop("_layer")


def scored_models(evals: DataFrame, summaries: DataFrame, requested: Sequence[str] = ()) -> DataFrame:
    """Evaluations of models that have a summary, or of exactly the requested models.

    A requested model without a summary, or no model at all, is an error.
    """
    ready = summaries.select("model").distinct()
    if requested:
        wanted = evals.sparkSession.createDataFrame([(m,) for m in requested], "model string")
        missing = [r.model for r in wanted.join(ready, "model", "left_anti").orderBy("model").collect()]
        if missing:
            raise ValueError("no rule summary for: " + ", ".join(missing))
        ready = ready.join(wanted, "model", "left_semi")
    if ready.isEmpty():
        raise ValueError("no model has a rule summary")
    return only_in(evals, ready, "model")


def problem_labels(dataset: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(id, label) of items in a known category; a repeated id is an error."""
    labels = dataset.select("id", F.col("problem_type_label").alias("label"))
    return require_unique(labels.filter(F.col("label").isin(list(categories))), ["id"])


def repeated_ids(rows: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    return duplicate_keys(rows, keys)


def with_label_parts(evals: DataFrame, families: Sequence[dict]) -> DataFrame:
    """Add ``family, variant, effort, max_tokens`` parsed from the model label.

    A family rule is ``{"tag", "patterns", "needles"}`` (see ``tag_by_rules``) with an
    optional ``prefix`` that is cut off to name the variant; without one the variant is
    the effort. Labels no rule matches are their own family.
    """
    base = F.regexp_replace("model", "__(effort|max-tokens)-.*$", "")
    rows = evals.withColumns({
        "family": F.coalesce(lb.tag_by_rules([base], list(families)), base),
        "effort": lb.artifact_effort("model"),
        "max_tokens": lb.artifact_max_tokens("model"),
    })
    variant = F.col("effort")
    for rule in families:
        if rule.get("prefix"):
            cut = F.replace(base, F.lit(rule["prefix"]), F.lit(""))
            variant = F.when(F.col("family") == rule["tag"], cut).otherwise(variant)
    return rows.withColumn("variant", variant)


def family_evaluations(evals: DataFrame, summaries: DataFrame, families: Sequence[dict]) -> DataFrame:
    """Evaluations of all models of the known families, with their label parts.

    Models without a summary (model, total), or with one that counts nothing, are left out, as
    are models of no known family; neither then narrows what ids the models have in common.
    """
    counted = only_in(evals, summaries.filter("total > 0"), "model")
    return with_label_parts(counted, families).filter(F.col("family").isin([rule["tag"] for rule in families]))
