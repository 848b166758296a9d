"""Judge grading: the judge's request, its reply, and the judged rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade import schemas
from sparkgrade.functions import labels as lb
from sparkgrade.functions import text as tx
from sparkgrade.functions.text import MISSING
from sparkgrade.operators import overlay
from sparkgrade.operators.compare import verdict_detail
from sparkgrade.operators.generation import payload_request
from sparkgrade.operators.scoring import reply_json, reply_object

REPLY = "is_correct string, reasoning_correct string, judge_reason string"


def judge_join(dataset: DataFrame, answers: DataFrame, keys: Sequence[str] = ("split", "id")) -> DataFrame:
    """Items with what the judge sees; ``request`` is NULL where no answer exists."""
    right = schemas.complete(answers, schemas.GENERATION).select(
        *keys,
        tx.clean_text(
            tx.first_text("final_answer_for_compare", "answer_boxed", "answer_sympy")
        ).alias("predict_answer"),
        tx.clean_text("model_response").alias("predict_reasoning"),
        F.lit(True).alias("has_answer"),
    )
    rows = schemas.complete(dataset, schemas.DATASET, schemas.OVERLAY).join(right, list(keys), "left")
    reference = tx.first_text(overlay.effective_reference(), overlay.effective_symbolic())
    rows = rows.select(
        *keys,
        lb.assignment_group(
            F.col("split"), F.col("chapter"), F.col("original_id"), F.col("problem_number"), F.col("id")
        ).alias("assignment_group"),
        tx.clean_text("question_type").alias("question_type"),
        tx.clean_text("answer_kind").alias("answer_kind"),
        tx.clean_text(overlay.effective_question()).alias("question"),
        tx.clean_text(overlay.effective_reasoning()).alias("reference_reasoning"),
        tx.clean_text(reference).alias("reference_answer"),
        F.coalesce("predict_answer", F.lit(MISSING)).alias("predict_answer"),
        F.coalesce("predict_reasoning", F.lit(MISSING)).alias("predict_reasoning"),
        F.coalesce("has_answer", F.lit(False)).alias("has_answer"),
        tx.points("points").alias("points"),
    )
    request = payload_request(
        "Evaluate this answer and reply with JSON only:",
        **{c: F.col(c) for c in (
            "question", "reference_reasoning", "reference_answer", "predict_reasoning", "predict_answer"
        )},
    )
    return rows.withColumn("request", F.when(F.col("has_answer"), request))


def usable_reply(reply: str) -> bool:
    """Whether a reply has both verdicts, for asking again where the row was scored."""
    found = reply_object(reply)
    return found is not None and all(
        str(found.get(k)).strip().lower() in (*tx.LOOSE_TRUE, *tx.LOOSE_FALSE) for k in ("is_correct", "reasoning_correct")
    )


def judge_verdict(reply: Column | str) -> Column:
    """``struct<answer_correct, reasoning_correct, judge_reason>``; unusable replies fail both."""
    parsed = reply_json(reply, REPLY)
    answer, reasoning = tx.loose_bool(parsed["is_correct"]), tx.loose_bool(parsed["reasoning_correct"])
    usable = answer.isNotNull() & reasoning.isNotNull()
    return F.struct(
        (usable & answer).alias("answer_correct"),
        (usable & reasoning).alias("reasoning_correct"),
        F.when(usable, tx.first_sentence(parsed["judge_reason"]))
        .otherwise("Judge output parse failed.").alias("judge_reason"),
    )


def judged_rows(rows: DataFrame, reply: Column | str) -> DataFrame:
    """Judge evaluations from :func:`judge_join` rows and the judge's reply column."""
    verdict = judge_verdict(reply)
    missing = F.struct(
        F.lit(False).alias("answer_correct"), F.lit(False).alias("reasoning_correct"),
        F.lit("Prediction missing.").alias("judge_reason"),
    )
    rows = rows.withColumn("_v", F.when(F.col("has_answer"), verdict).otherwise(missing))
    answer = F.coalesce(F.col("_v.answer_correct"), F.lit(False))
    reasoning = F.coalesce(F.col("_v.reasoning_correct"), F.lit(False))
    return rows.withColumns({
        "answer_correct": answer,
        "reasoning_correct": reasoning,
        "detail": verdict_detail(answer, reasoning),
        "judge_reason": F.col("_v.judge_reason"),
        "points_earned": F.when(answer, F.col("points")).otherwise(0.0),
    }).drop("_v", "has_answer", "request", "question")
