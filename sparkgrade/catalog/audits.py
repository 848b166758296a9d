"""Catalogue: the audit jobs, label balancing, error export and category reports as whole jobs."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrade.catalog.registry import items, query, table, text
from sparkgrade.plans import audits


def auditor_stub() -> Callable[[str], str]:
    """Finds issues by the item's number; every eleventh item gets no usable reply."""
    def call(request: str) -> str:
        item = json.loads(request.split("\n", 1)[1])["item"]
        number = int(item["id"])
        if number % 11 == 0:
            return "no verdict"
        lost = [{"severity": "Warning", "code": "Sign - lost", "message": " minus gone "}] if number % 3 == 0 else []
        vague = [{"severity": "error", "code": " ", "message": ""}, None] if number % 4 == 0 else []
        score = "n/a" if number % 7 == 0 else number % 10
        reply = {"conversion": {"issues": lost}, "extraction": {"issues": vague}, "overall": {"score": score}}
        return f"```json\n{json.dumps(reply)}\n```" if number % 2 else json.dumps(reply)

    return call


def _audit(spark: SparkSession, folder: str) -> audits.ConversionAudit:
    docs = table(spark, folder, "documents")
    number = text("doc_id")
    rows = docs.select(
        F.col("lang").alias("split"), number.alias("id"), F.col("lang").alias("chapter"), number.alias("problem_number"),
        F.lit("i").alias("sub_id"), F.lit("").alias("source_path"), F.col("text").alias("question_standalone"),
    )
    key = F.concat("lang", F.lit("/out_split/"), number, F.lit("/main.json"))
    source = F.struct(F.col("text").alias("problem_latex"), F.col("source").alias("answer_latex"))
    return audits.conversion_audit(rows, docs.where("lang != 'es'").select(key.alias("source_key"), source.alias("source")), auditor_stub)


_AUDIT_SQL = """
    d AS (SELECT lang AS split, doc_id AS n, lang = 'es' AS lost, lang <> 'es' AND doc_id % 11 = 0 AS failed FROM documents),
    found AS (
      SELECT split, n, 'source' AS stage, 'error' AS severity, 'out_split_source_missing' AS code, 'No source file for this item.' AS message FROM d WHERE lost
      UNION ALL SELECT split, n, 'llm_eval', 'error', 'llm_eval_failed', 'Audit failed: unusable reply' FROM d WHERE failed
      UNION ALL SELECT split, n, 'conversion', 'warn', 'sign_lost', 'minus gone' FROM d WHERE NOT lost AND NOT failed AND n % 3 = 0
      UNION ALL SELECT split, n, 'extraction', 'error', 'llm_issue', 'extraction issue flagged by LLM' FROM d WHERE NOT lost AND NOT failed AND n % 4 = 0)"""


@query(f"WITH {_AUDIT_SQL} SELECT split, CAST(n AS VARCHAR) AS id, stage, severity, code, message FROM found")
def conversion_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The conversion audit: issues of the replies, of lost sources and of failed audits."""
    return _audit(spark, folder).issues.select("split", "id", "stage", "severity", "code", "message")


@query(f"""
    WITH {_AUDIT_SQL}
    SELECT (SELECT count(*) FROM d) AS total_rows, (SELECT count(DISTINCT n) FROM found) AS rows_with_issues, (SELECT count(*) FROM found) AS total_issues,
           count(*) FILTER (lost) AS missing_source_rows, count(*) FILTER (NOT lost AND NOT failed AND n % 7 <> 0) AS scored_rows,
           round(avg(n % 10) FILTER (NOT lost AND NOT failed AND n % 7 <> 0), 4) AS mean_score
    FROM d
""")
def conversion_audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The audit's totals in one row."""
    return _audit(spark, folder).summary().withColumn("mean_score", F.round("mean_score", 4))


@query(f"""
    WITH {_AUDIT_SQL}
    SELECT code, count(*) AS n FROM found GROUP BY 1
""")
def conversion_audit_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The audit's issue codes by frequency."""
    return _audit(spark, folder).top_codes()


def _confirmed(spark: SparkSession, folder: str) -> audits.ConfirmedDataset:
    old = F.lit("old")
    base = items(spark, folder).select(
        "id", F.when(F.col("split") != "fr", F.col("split")).otherwise(" ").alias("split"), "chapter", "_pos",
        *[old.alias(c) for c in ("question_standalone", "question_final", "reference_reasoning", "reference_answer_sympy", "final_answer_for_compare")],
        F.lit("true").alias("reference_answer"),
    )
    blank = F.lit(" ")
    export = table(spark, folder, "labels").select(
        text("doc_id").alias("id"), F.col("doc_id").alias("_pos"), F.when(F.col("toxic") == 1, " 5 ").otherwise("").alias("comment"),
        F.when(F.col("quality") == 0, F.array(F.lit("1"), F.lit("5"))).alias("codes"),
        F.when(F.col("quality") == 1, "New  question").alias("question"), blank.alias("reasoning"),
        F.when(F.col("toxic") == 1, "False").alias("answer_reference"), blank.alias("answer_sympy"), blank.alias("answer_compare"),
    )
    # An earlier row of every id, which the last one replaces.
    export = export.unionByName(export.withColumns({"_pos": F.lit(-1), "comment": F.lit("5"), "question": F.lit("older")}))
    number = F.col("doc_id")
    expert = table(spark, folder, "documents").select(
        F.concat(F.lit("part_"), number % 7).alias("split"), text("doc_id").alias("id"), F.lit("e").alias("annotator"),
        F.when(number % 2 == 0, " ").otherwise("see").alias("comment"), F.lit("").alias("question"),
        F.lit(None).cast("string").alias("solution"), F.lit("\t").alias("answer"), F.lit("today").alias("saved_at"),
    )
    sampled = expert.where("split != 'part_3'").select("split", "id")
    explicit = table(spark, folder, "benchmark").select(text("item_id").alias("id"))
    excluded = table(spark, folder, "supplier").select(text("s_suppkey").alias("id"))
    return audits.confirmed_dataset(base, export, expert, sampled, explicit, excluded)


_DATASET_SQL = """
    d AS (SELECT doc_id AS id, CASE WHEN lang <> 'fr' THEN lang ELSE 'chapter_' || source END AS split, doc_id % 7 <> 3 AS sampled FROM documents),
    l AS (SELECT doc_id AS id, toxic = 1 AS toxic, quality = 1 AS good, toxic = 1 OR quality = 0 AS coded FROM labels),
    candidates AS (
      SELECT id, 1 AS bucket FROM l WHERE coded
      UNION ALL SELECT DISTINCT item_id, 2 FROM benchmark
      UNION ALL SELECT id, 3 FROM d WHERE sampled AND id % 2 = 0 AND id NOT IN (SELECT item_id FROM benchmark) AND id NOT IN (SELECT s_suppkey FROM supplier)),
    resolved AS (
      SELECT c.id, bucket, CASE WHEN d.id IS NULL THEN 'missing_base' WHEN bucket > 1 AND l.id IS NULL THEN 'missing_export'
        WHEN bucket > 1 AND NOT d.sampled THEN 'missing_expert' ELSE 'selected' END AS status
      FROM candidates c LEFT JOIN d USING (id) LEFT JOIN l USING (id)),
    out AS (
      SELECT id, max(bucket) AS bucket FROM resolved WHERE status = 'selected' GROUP BY 1)"""


@query(f"""
    WITH {_DATASET_SQL}
    SELECT split, CAST(id AS VARCHAR) AS id, ['non_expert_comment_5', 'expert_explicitly_correct', 'expert_silent_no_change'][bucket] AS confirmation_bucket,
           CASE WHEN good THEN 'New question' ELSE 'old' END AS question_final, CASE WHEN toxic THEN 'false' ELSE 'true' END AS reference_answer,
           CASE WHEN bucket = 1 THEN NULL WHEN id % 2 = 0 THEN ' ' ELSE 'see' END AS expert_comment
    FROM out JOIN d USING (id) JOIN l USING (id)
""")
def confirmed_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """The confirmed-dataset job: reviewed values, buckets and the expert's comment."""
    return _confirmed(spark, folder).items.select(
        "split", "id", "confirmation_bucket", "question_final", "reference_answer", "expert_comment")


@query(f"""
    WITH {_DATASET_SQL}
    SELECT 'bucket' AS section, ['non_expert_comment_5', 'expert_explicitly_correct', 'expert_silent_no_change'][bucket] AS name, count(*) AS n FROM out GROUP BY ALL
    UNION ALL SELECT 'split', split, count(*) FROM out JOIN d USING (id) GROUP BY ALL
    UNION ALL SELECT 'missing', status, count(*) FROM resolved WHERE status <> 'selected' GROUP BY ALL
    UNION ALL SELECT 'ignored', 'expert_context_not_sampled_subquestion', count(*) FROM d WHERE NOT sampled HAVING count(*) > 0
""")
def confirmed_dataset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of the confirmed-dataset job, ignored expert entries among them."""
    return _confirmed(spark, folder).manifest()
