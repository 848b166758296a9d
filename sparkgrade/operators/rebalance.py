"""Balancing the labels of judge questions by rewriting some of the majority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions import text as tx
from sparkgrade.functions.text import as_column
from sparkgrade.operators.keys import sample_rows
from sparkgrade.operators.scoring import reply_json, reply_object
from sparkgrade.operators.summary import label_balance
from sparkgrade.session import cut_lineage

# Columns that hold the question and the answer of an item.
QUESTION_FIELDS = ["question_original", "split_question", "question_standalone", "question_final"]
REFERENCE_FIELDS = [
    "reference_answer_original", "reference_answer_corrected", "split_answer", "reference_answer",
    "final_answer_for_compare",
]
# Order in which a label is looked for.
LABEL_FIELDS = [
    "reference_answer", "final_answer_for_compare", "reference_answer_corrected",
    "reference_answer_original", "split_answer",
]
REPLY = "rewritten_question string, new_label string, flipped string, natural string"


def judge_label(columns: list[str]) -> Column:
    """First field that reads as a boolean answer."""
    return F.coalesce(*[tx.answer_bool(c) for c in LABEL_FIELDS if c in columns], F.lit(None).cast("string"))


def question_text(columns: list[str]) -> Column:
    order = ["question_final", "question_standalone", "split_question", "question_original"]
    return F.coalesce(tx.first_text(*[c for c in order if c in columns]), F.lit(""))


def flips_needed(labelled: DataFrame) -> DataFrame:
    """One row: label counts, the majority label and how many of it to flip."""
    counts = label_balance(labelled).select("true", "false")
    return counts.select(
        "true",
        "false",
        F.when(F.col("true") >= F.col("false"), "True").otherwise("False").alias("majority"),
        F.floor(F.abs(F.col("true") - F.col("false")) / 2).cast("bigint").alias("flips"),
    )


def rebalance_plan(labelled: DataFrame, seed: int = 42, keys: tuple[str, ...] = ("split", "id")) -> DataFrame:
    """The rows to flip: a seeded choice among judge questions with the majority label.

    ``labelled`` has ``label`` and ``question_type``. The needed number may be half of
    the table, so it enters as a scalar subquery and no row list reaches the driver.
    """
    plan = cut_lineage(flips_needed(labelled), "flips")
    majority, flips = plan.select("majority").scalar(), plan.select("flips").scalar()
    judged = labelled.filter(F.lower(tx.strip("question_type")) == "judge")
    return sample_rows(judged.filter(F.col("label") == majority), flips, seed, list(keys))


def rewrite_check(reply: Column | str, old_label: Column | str) -> Column:
    """Why a rewrite is refused, NULL when it is accepted."""
    parsed = reply_json(reply, REPLY)
    label = tx.answer_bool(parsed["new_label"])
    return (
        F.when(tx.blank_to_null(parsed["rewritten_question"]).isNull(), "empty rewritten_question")
        .when(label.isNull(), "new_label is not True/False")
        .when(label == as_column(old_label), "new_label did not flip")
        .when(~F.coalesce(tx.loose_bool(parsed["flipped"]), F.lit(False)), "flipped is not true")
        .when(~F.coalesce(tx.loose_bool(parsed["natural"]), F.lit(False)), "natural is not true")
    )


def usable_rewrite(reply: str) -> bool:
    """Whether a reply can be a rewrite, for asking again where the row was scored; whether
    its label flipped is for :func:`rewrite_check`, which knows the old one."""
    found = reply_object(reply) or {}
    flags = all(str(found.get(k)).strip().lower() in tx.LOOSE_TRUE for k in ("flipped", "natural"))
    label = str(found.get("new_label")).strip().lower() in (*tx.ANSWER_TRUE, *tx.ANSWER_FALSE)
    return flags and label and bool(str(found.get("rewritten_question") or "").strip())


def accepted_rewrites(planned: DataFrame, reply: Column | str, keys: tuple[str, ...] = ("split", "id")) -> DataFrame:
    """Keys, new question and new label of the rewrites that pass the check."""
    parsed = reply_json(reply, REPLY)
    checked = planned.withColumn("_reason", rewrite_check(reply, "label"))
    return checked.filter("_reason IS NULL").select(
        *keys,
        tx.strip(parsed["rewritten_question"]).alias("rewritten_question"),
        tx.flip_bool("label").alias("new_label"),
    )


def apply_flips(rows: DataFrame, flips: DataFrame, keys: tuple[str, ...] = ("split", "id")) -> DataFrame:
    """Rewritten questions and labels put into every field the table has."""
    joined = rows.join(flips, list(keys), "left")
    flipped = F.col("new_label").isNotNull()
    changes = {
        c: F.when(flipped, F.col("rewritten_question")).otherwise(F.col(c))
        for c in QUESTION_FIELDS if c in rows.columns
    }
    changes |= {
        c: F.when(flipped, F.col("new_label")).otherwise(F.col(c)) for c in REFERENCE_FIELDS if c in rows.columns
    }
    if "reference_answer_sympy" in rows.columns:
        changes["reference_answer_sympy"] = F.when(flipped, tx.MISSING).otherwise(F.col("reference_answer_sympy"))
    changes["flipped"] = flipped
    return joined.withColumns(changes).drop("rewritten_question", "new_label")


def rebalance_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Label counts per split before and after."""
    old = label_balance(before.withColumn("label", judge_label(before.columns)), ["split"])
    new = label_balance(after.withColumn("label", judge_label(after.columns)), ["split"])
    names = [c for c in old.columns if c != "split"]
    return old.select("split", *[F.col(c).alias(f"{c}_before") for c in names]).join(
        new.select("split", *[F.col(c).alias(f"{c}_after") for c in names]), "split", "full"
    )
