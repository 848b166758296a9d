"""Confirmed dataset: items a reviewer or an expert has approved, in three buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions import text as tx
from sparkgrade.functions.text import as_column
from sparkgrade.operators.keys import head_per_group

# The buckets, a later one replacing an earlier one, and their status.
BUCKETS = {
    "non_expert_comment_5": "confirmed_without_expert",
    "expert_explicitly_correct": "confirmed_by_expert",
    "expert_silent_no_change": "confirmed_by_expert",
}


def has_code(comment: Column | str, codes: Column | str, code: str = "5") -> Column:
    """The comment is the code, or the list of codes holds it."""
    listed = F.exists(as_column(codes), lambda c: tx.strip(c) == code)
    return F.coalesce(tx.strip(comment) == code, F.lit(False)) | F.coalesce(listed, F.lit(False))


def is_silent(*fields: Column | str) -> Column:
    """All review fields are blank: the expert saw the item and changed nothing."""
    return reduce(lambda a, b: a & b, [tx.blank_to_null(f).isNull() for f in fields])


def sampled_entries(entries: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expert entries of sampled (split, id) pairs, and the others, which are ignored."""
    keys = ["split", "id"]
    ignored = entries.join(pairs.select(*keys), keys, "left_anti").select(
        *keys, F.lit("expert_context_not_sampled_subquestion").alias("reason")
    )
    return entries.join(pairs.select(*keys).distinct(), keys, "left_semi"), ignored


def bucket_candidates(
    export: DataFrame, expert: DataFrame, explicit: DataFrame, excluded: DataFrame
) -> DataFrame:
    """``id, bucket``: which items each bucket asks for, before any table is consulted.

    ``export`` has ``id, comment, codes``; ``expert`` ``id`` and ``silent``; ``explicit``
    and ``excluded`` are lists of ids.
    """
    reviewed = export.filter(has_code("comment", "codes")).select("id", F.lit(1).alias("bucket"))
    named = explicit.select("id", F.lit(2).alias("bucket"))
    silent = (
        expert.filter("silent").select("id").distinct()
        .join(excluded.select("id"), "id", "left_anti")
        .join(explicit.select("id"), "id", "left_anti")
        .select("id", F.lit(3).alias("bucket"))
    )
    return reviewed.unionByName(named).unionByName(silent)


def resolve_candidates(candidates: DataFrame, base: DataFrame, export: DataFrame, expert: DataFrame) -> DataFrame:
    """Add ``status``: ``selected`` or the first table the item is missing from.

    The first bucket needs only the base row; the expert buckets need all three tables.
    """
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("id").distinct().withColumn(name, F.lit(True))

    rows = (
        candidates.join(flag(base, "_base"), "id", "left")
        .join(flag(export, "_export"), "id", "left")
        .join(flag(expert, "_expert"), "id", "left")
    )
    by_expert = F.col("bucket") > 1
    return rows.select(
        "id",
        "bucket",
        F.when(F.col("_base").isNull(), "missing_base")
        .when(by_expert & F.col("_export").isNull(), "missing_export")
        .when(by_expert & F.col("_expert").isNull(), "missing_expert")
        .otherwise("selected").alias("status"),
    )


def confirmed_items(resolved: DataFrame) -> DataFrame:
    """One row per selected id with the name and status of its last bucket."""
    names, states = list(BUCKETS), list(BUCKETS.values())
    last = head_per_group(resolved.filter("status = 'selected'"), ["id"], [F.desc("bucket")], 1)
    place = F.col("bucket")
    return last.select(
        "id",
        F.element_at(F.array(*[F.lit(n) for n in names]), place).alias("confirmation_bucket"),
        F.element_at(F.array(*[F.lit(s) for s in states]), place).alias("confirmation_status"),
    )


def coerce_reference(existing: Column | str, text: Column | str) -> Column:
    """A reviewed reference in the shape of the value it replaces (JSON text on both sides).

    A boolean stays a boolean when the text spells one; an object stays an object when
    the text parses as JSON; anything else is text.
    """
    old, new = as_column(existing), tx.collapse_spaces(text)
    was_bool = F.lower(tx.strip(old)).isin("true", "false")
    spelled = F.lower(new).isin("true", "false")
    return F.when(F.coalesce(new == "", F.lit(True)), old).when(was_bool & spelled, F.lower(new)).otherwise(new)


def materialise_reviews(items: DataFrame, reviews: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Put reviewed values into the base columns.

    ``reviews`` has the keys and ``question, reasoning, answer_reference, answer_sympy,
    answer_compare``, each already the first non-blank of its sources.
    """
    joined = items.join(
        reviews.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in (
            "question", "reasoning", "answer_reference", "answer_sympy", "answer_compare"
        )]),
        list(keys), "left",
    )

    def put(new: str, old: str) -> Column:
        return tx.clean_text(new, F.col(old))

    return joined.withColumns({
        "question_standalone": put("_r_question", "question_standalone"),
        "question_final": put("_r_question", "question_final"),
        "reference_reasoning": put("_r_reasoning", "reference_reasoning"),
        "reference_answer": coerce_reference("reference_answer", "_r_answer_reference"),
        "reference_answer_sympy": put("_r_answer_sympy", "reference_answer_sympy"),
        "final_answer_for_compare": put("_r_answer_compare", "final_answer_for_compare"),
    }).drop("_r_question", "_r_reasoning", "_r_answer_reference", "_r_answer_sympy", "_r_answer_compare")


def json_instruction(keys: Column) -> Column:
    # Fixed value: the sentence that asks for a JSON answer.
    return F.concat(
        F.lit("Return the final answer as a JSON object with exactly these keys: "),
        F.array_join(keys, ", "),
        F.lit(". Use double-quoted JSON keys and string values."),
    )


def apply_patches(items: DataFrame, patches: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("id",)) -> DataFrame:
    """Per-id corrections from a patch table.

    ``patches`` has the keys and, as far as present: the patched ``columns`` (NULL keeps
    the old value), ``replace_from`` / ``replace_to`` for the question text, and
    ``json_keys`` which appends the JSON instruction once.
    """
    present = patches.columns
    renamed = patches.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in present if c not in keys])
    rows = items.join(renamed, list(keys), "left")
    rows = rows.withColumns({c: F.coalesce(f"_p_{c}", c) for c in columns if c in present})
    question = F.col("question_final")
    if "replace_from" in present:
        question = F.when(
            F.col("_p_replace_from").isNotNull(),
            F.replace(question, F.col("_p_replace_from"), F.coalesce("_p_replace_to", F.lit(""))),
        ).otherwise(question)
    if "json_keys" in present:
        body = F.regexp_replace(question, r"(?U)\s+$", "")
        asked = json_instruction(F.col("_p_json_keys"))
        appended = F.when(F.contains(body, asked), body).otherwise(F.concat(body, F.lit("\n\n"), asked))
        question = F.when(F.col("_p_json_keys").isNotNull(), tx.strip(appended)).otherwise(question)
    return rows.withColumn("question_final", question).drop(*[f"_p_{c}" for c in present if c not in keys])


def manifest(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """Totals by bucket, rows per split, and how many candidates each table lacked."""
    by_bucket = items.groupBy(F.col("confirmation_bucket").alias("name")).agg(F.count("*").alias("n"))
    by_split = items.groupBy(F.col("split").alias("name")).agg(F.count("*").alias("n"))
    missing = resolved.filter("status != 'selected'").groupBy(F.col("status").alias("name")).agg(
        F.count("*").alias("n")
    )
    parts = {"bucket": by_bucket, "split": by_split, "missing": missing}
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(section).alias("section"), "name", "n") for section, df in parts.items()
    ])
