"""Catalogue: whole evaluation jobs on tables that hold repeats, and replies asked for again."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrade.catalog import scores, upkeep  # noqa: F401  their oracles serve here, too
from sparkgrade.catalog.grades import _DISPATCH_SQL, _orders_as_answers, _orders_as_items
from sparkgrade.catalog.registry import ORACLES, everything, items, label_verdicts, query, table, text
from sparkgrade.operators import scoring
from sparkgrade.plans import evaluate, reports
from sparkgrade.session import cut_lineage


def _with_older(df: DataFrame, column: str) -> DataFrame:
    """Every row a second time, in front of it in the row order, with another value."""
    older = df.withColumns({column: F.lit("older"), "_pos": F.lit(1)})
    return df.withColumn("_pos", F.lit(2)).unionByName(older)


@query(f"""
    {_DISPATCH_SQL}
    SELECT id, split, is_correct, detail FROM verdicts
""")
def rule_job(spark: SparkSession, folder: str) -> DataFrame:
    """The rule job where items and answers repeat: the last row of each counts."""
    dataset = _with_older(_orders_as_items(spark, folder), "reference_answer")
    answers = _with_older(_orders_as_answers(spark, folder), "final_answer_for_compare")
    return evaluate.rule_evaluation(dataset, answers, "m").rows.select("id", "split", "is_correct", "detail")


def unsure_judge() -> Callable[[str], str]:
    """Gives an unusable reply first, and a verdict when it is asked again."""
    asked: set[str] = set()

    def call(request: str) -> str:
        if request not in asked:
            asked.add(request)
            return "I am not sure."
        return json.dumps({"is_correct": "Band" in request, "reasoning_correct": "yes", "judge_reason": "Seen twice. More."})

    return call


@query(f"""
    {_DISPATCH_SQL}
    SELECT id, kind = '2-HIGH' AS answer_correct, CASE WHEN missing THEN 'both_wrong' WHEN kind = '2-HIGH' THEN 'ok' ELSE 'wrong_answer' END AS detail,
           CASE WHEN missing THEN 'Prediction missing.' ELSE 'Seen twice.' END AS judge_reason
    FROM verdicts
""")
def judge_job(spark: SparkSession, folder: str) -> DataFrame:
    """The judge job: repeats as before, and replies asked for until they are usable."""
    dataset = _with_older(_orders_as_items(spark, folder), "reference_answer")
    answers = _with_older(_orders_as_answers(spark, folder), "final_answer_for_compare")
    judged = evaluate.judge_evaluation(dataset, answers, "m", "j", unsure_judge)
    return judged.rows.select("id", "answer_correct", "detail", "judge_reason")


@query("""
    SELECT lang AS split, CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 2 END AS attempts,
           CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'success' END AS status,
           CASE WHEN doc_id % 5 = 0 THEN 'unusable reply' END AS error
    FROM documents
""")
def reply_retries(spark: SparkSession, folder: str) -> DataFrame:
    """A refused reply is a failed attempt; the row fails when no attempt is usable."""
    def scorer() -> Callable[[str], str]:
        reply = unsure_judge()
        return lambda request: "never" if int(request) % 5 == 0 else reply(request)

    scored = items(spark, folder).withColumn("scored", scoring.score("id", scorer, 3, accept=scoring.is_object))
    rows = cut_lineage(scored.select("split", "id", "scored"), "retries")
    return rows.select("split", "id", "scored.attempts", "scored.status", "scored.error")


@query("""
    WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice > 250000 AS r, o_orderstatus = 'F' AS a FROM orders)
    SELECT id, CASE WHEN NOT r AND NOT a THEN 'same_fail_answer' WHEN NOT r THEN 'rule_fail_llm_pass_answer' ELSE 'rule_pass_llm_fail_answer' END AS comparison_note
    FROM t WHERE NOT (r AND a)
""")
def rater_job(spark: SparkSession, folder: str) -> DataFrame:
    """Two graders compared where their rows repeat: the last row of each counts."""
    orders = table(spark, folder, "orders").select(
        text("o_orderkey").alias("id"), F.col("o_orderstatus").alias("split"),
        (F.col("o_totalprice") > 250000).cast("string").alias("rule_ok"), (F.col("o_orderstatus") == "F").cast("string").alias("answer_ok"),
    )
    blank = F.lit("x")
    dataset = orders.select("split", "id", blank.alias("question"), blank.alias("question_type"), blank.alias("answer_kind"), blank.alias("reference_answer"))
    rule = orders.select("split", "id", F.col("rule_ok").alias("is_correct"), blank.alias("detail"), blank.alias("prediction"), blank.alias("reference"))
    judge = orders.select(
        "split", "id", F.col("answer_ok").alias("answer_correct"), F.lit("true").alias("reasoning_correct"), blank.alias("detail"),
        blank.alias("judge_reason"), blank.alias("predict_answer"), blank.alias("reference_reasoning"), blank.alias("predict_reasoning"),
    )
    rows, _ = evaluate.rater_comparison(
        _with_older(dataset, "question"), _with_older(rule, "is_correct"), _with_older(judge, "answer_correct"),
    )
    return rows.select("id", "comparison_note")


@query(ORACLES["token_limit_rows"])
def token_limit_job(spark: SparkSession, folder: str) -> DataFrame:
    """The rerun job: only unanswered rows are looked up in the call log."""
    rows, _ = reports.token_limit_report(upkeep._answers(spark, folder), upkeep._calls(spark, folder), 32768, ["ts", "event_id"])
    return rows.select("id", "split", "usage_output_tokens", "max_solve_tokens", "threshold_tokens", "request_id", "model_response_empty")


@query(ORACLES["token_limit_funnel"])
def token_limit_job_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """The funnel of the rerun job."""
    _, funnel = reports.token_limit_report(upkeep._answers(spark, folder), upkeep._calls(spark, folder), 32768, ["ts", "event_id"])
    return funnel.select(everything("split").alias("split"), "rows_scanned", "missing_answer_rows", "missing_without_cost",
                         "missing_below_threshold", "selected_rows")


def _artifacts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Verdicts of two graders as tables of their own, and a dataset that lost some items."""
    docs = table(spark, folder, "documents").select(text("doc_id").alias("id"), F.col("lang").alias("split"), F.col("n_chars"))
    verdicts = label_verdicts(spark, folder).join(docs.select("id", "split"), "id").withColumn("points", F.lit(1.0))
    return verdicts.withColumn("points_earned", F.col("is_correct").cast("double")), docs.where("n_chars < 2000").select("split", "id")


_PRUNED_SQL = """
    WITH evals AS (
      SELECT CAST(l.doc_id AS VARCHAR) AS id, d.lang AS split, m.model, CASE m.model WHEN 'quality' THEN quality = 1 ELSE toxic = 0 END AS ok,
             d.n_chars < 2000 OR d.lang NOT IN (SELECT lang FROM documents WHERE n_chars < 2000) AS kept
      FROM labels l JOIN documents d USING (doc_id), (VALUES ('quality'), ('toxic')) m(model))"""


@query(f"""
    {_PRUNED_SQL}
    SELECT model, id, split, ok AS is_correct FROM evals WHERE kept
""")
def prune_job(spark: SparkSession, folder: str) -> DataFrame:
    """Stored results without the items that left the dataset."""
    evals, dataset = _artifacts(spark, folder)
    return evaluate.prune_artifacts({"evals": evals}, dataset)["evals"].select("model", "id", "split", "is_correct")


@query(f"""
    {_PRUNED_SQL}
    SELECT model, count(*) AS total, count(*) FILTER (ok) AS correct FROM evals
    WHERE kept AND model IN (SELECT model FROM evals WHERE NOT kept) GROUP BY model
""")
def rebuild_job(spark: SparkSession, folder: str) -> DataFrame:
    """Score tables made anew for the models that lost rows."""
    evals, dataset = _artifacts(spark, folder)
    plan = evaluate.prune_artifacts({"evals": evals}, dataset, dry_run=True)["evals"]
    kept, removed = plan.where("status = 'kept'").drop("status"), plan.where("status = 'removed'")
    scores = evaluate.rebuild_summaries({"evals": kept}, {"evals": removed})["evals"]
    return scores.where("level = 'overall'").select("model", "total", "correct")


@query(ORACLES["length_breakdown"])
def length_job(spark: SparkSession, folder: str) -> DataFrame:
    """The length report, whose word counts are written once."""
    orders = table(spark, folder, "orders").select(
        F.lit("orders").alias("model"), text("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("is_correct"),
    )
    evals = label_verdicts(spark, folder).unionByName(orders)
    return reports.length_report(items(spark, folder), evals, "question_final").breakdown.select(
        "model", "length_bin", "bin_order", "bin_label", "total", "correct",
        F.round("accuracy", 6).alias("accuracy"), "missing_eval_count", "extra_eval_count",
    )
