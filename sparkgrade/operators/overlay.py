"""Reviewer overlays: review entries, answer overrides, effective values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions import answers as an
from sparkgrade.functions import text as tx
from sparkgrade.functions.text import as_column
from sparkgrade.operators.keys import last_per_key

# Where an answer object keeps its text, symbolic and compare forms.
TEXT_KEYS = ["reference_answer", "answer", "final_answer", "text", "value"]
SYMBOLIC_KEYS = ["reference_answer_sympy", "answer_sympy", "sympy", "final_answer_for_compare", "value_sympy"]
COMPARE_KEYS = [
    "final_answer_for_compare", "reference_answer_sympy", "reference_answer", "answer", "final_answer", "value",
]


def is_meaningful(value: Column | str) -> Column:
    """Neither NULL, blank, an empty object nor an empty list."""
    body = tx.blank_to_null(as_column(value).cast("string"))
    return body.isNotNull() & ~F.coalesce(body.rlike(r"^(\{\s*\}|\[\s*\])$"), F.lit(False))


def answer_overrides(raw: Column | str) -> dict[str, Column]:
    """Text, symbolic and compare forms of a reviewer's answer.

    The answer is plain text, or a JSON object whose known keys are searched in order;
    an object with none of the text keys stands for itself as JSON.
    """
    body = F.coalesce(tx.strip(as_column(raw)), F.lit(""))
    parsed = F.from_json(F.when(F.startswith(body, F.lit("{")), body), "map<string,string>")

    def pick(keys: Sequence[str]) -> Column:
        return tx.first_text(*[F.try_element_at(parsed, F.lit(k)) for k in keys])

    text = F.coalesce(pick(TEXT_KEYS), F.when(F.size(parsed) > 0, an.json_text(parsed)), F.lit(""))
    symbolic = F.coalesce(pick(SYMBOLIC_KEYS), F.lit(""))
    compare = F.coalesce(pick(COMPARE_KEYS), tx.null_if_empty(symbolic), text)
    is_object = parsed.isNotNull()
    return {
        "annotator_rewritten_answer_reference": F.when(is_object, text).otherwise(body),
        "annotator_rewritten_answer_sympy": F.when(is_object, symbolic).otherwise(body),
        "annotator_rewritten_answer_compare": F.when(is_object, compare).otherwise(body),
    }


def review_entries(documents: DataFrame) -> DataFrame:
    """Explode review documents into one row per (split, id), the last path winning.

    ``documents`` has ``split, path, annotator, entries``; the annotator falls back to
    the folder name.
    """
    entry = F.col("entry")
    folder = F.element_at(F.split("path", "/"), -2)
    rows = documents.select(
        "split", "path", "annotator", F.explode("entries").alias("key", "entry")
    ).select(
        "split",
        F.coalesce(tx.first_text("key", entry["question_id"]), F.lit("")).alias("id"),
        F.coalesce(tx.blank_to_null("annotator"), folder).alias("annotator"),
        F.coalesce(tx.blank_to_null(entry["annotator_rewritten_question"]), F.lit("")).alias("annotator_rewritten_question"),
        F.coalesce(tx.blank_to_null(entry["annotator_rewritten_solution"]), F.lit("")).alias("annotator_rewritten_solution"),
        F.coalesce(entry["annotator_rewritten_answer"], entry["annotation"]).alias("annotator_rewritten_answer"),
        F.coalesce(tx.strip(F.coalesce(entry["annotator_comment"], entry["comment"])), F.lit("")).alias("annotator_comment"),
        F.coalesce(tx.strip(entry["saved_at"]), F.lit("")).alias("saved_at"),
        "path",
    )
    latest = last_per_key(rows.filter("id != ''"), ["split", "id"], ["path"]).drop("path")
    return latest.withColumns({
        "has_question_override": is_meaningful("annotator_rewritten_question"),
        "has_solution_override": is_meaningful("annotator_rewritten_solution"),
        "has_answer_override": is_meaningful("annotator_rewritten_answer"),
    })


def apply_overrides(dataset: DataFrame, entries: DataFrame, keys: Sequence[str] = ("split", "id")) -> DataFrame:
    """Dataset with reviewer columns; rows without a review get empty ones."""
    reviewed = entries.select(
        *keys,
        "annotator",
        "annotator_rewritten_question",
        "annotator_rewritten_solution",
        "annotator_rewritten_answer",
        "annotator_comment",
        F.col("saved_at").alias("annotator_override_saved_at"),
    )
    out = dataset.join(reviewed, list(keys), "left")
    active = (
        is_meaningful("annotator_rewritten_question")
        | is_meaningful("annotator_rewritten_solution")
        | is_meaningful("annotator_rewritten_answer")
    )
    out = out.withColumns({
        "annotator_override_active": active,
        **answer_overrides("annotator_rewritten_answer"),
    })
    empty = ["annotator_rewritten_question", "annotator_rewritten_solution", "annotator_comment"]
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in empty})


def effective_question() -> Column:
    return F.coalesce(
        tx.first_text("annotator_rewritten_question", "question_final", "question_standalone"), F.lit("")
    )


def effective_reasoning() -> Column:
    return F.coalesce(tx.first_text("annotator_rewritten_solution", "reference_reasoning"), F.lit(""))


def _reviewed(form: str, *fallbacks: str) -> Column:
    own = F.coalesce(tx.first_text(*fallbacks), F.lit(""))
    return F.when(is_meaningful("annotator_rewritten_answer"), tx.strip(form)).otherwise(own)


def effective_reference() -> Column:
    return _reviewed("annotator_rewritten_answer_reference", "reference_answer")


def effective_symbolic() -> Column:
    return _reviewed("annotator_rewritten_answer_sympy", "reference_answer_sympy")


def effective_compare() -> Column:
    return _reviewed(
        "annotator_rewritten_answer_compare",
        "final_answer_for_compare", "reference_answer_sympy", "reference_answer",
    )
