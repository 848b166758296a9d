"""Catalogue: accuracy tables, comparison, export, length and category breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrade.catalog.registry import WS, everything, items, label_verdicts, query, table, text
from sparkgrade.functions import labels as lb
from sparkgrade.functions import text as tx
from sparkgrade.functions.order import group_key
from sparkgrade.operators import categories, compare, grading, lengths, merge, summary


def _document_grades(spark: SparkSession, folder: str, how: str) -> DataFrame:
    """Documents joined with their quality label, one point each."""
    labels = table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("is_correct"))
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("split"))
    graded = docs.join(labels, "doc_id", how)
    return graded.withColumns({
        "points": F.lit(1.0),
        "points_earned": F.when(F.coalesce("is_correct", F.lit(False)), 1.0).otherwise(0.0),
    })


def _accuracy_columns(summary_rows: DataFrame, *owner: str) -> DataFrame:
    return summary_rows.select(
        *owner, everything("split").alias("split"), "total", "correct", F.round("accuracy", 6).alias("accuracy"),
        F.round("total_points", 4).alias("total_points"), F.round("earned_points", 4).alias("earned_points"),
        F.round("weighted_accuracy", 6).alias("weighted_accuracy"),
    )


def _accuracy_sql(rows: str, split: str = "split") -> str:
    return f"""
    WITH rows AS ({rows})
    SELECT coalesce({split}, 'ALL') AS split, count(*) AS total,
           count(*) FILTER (coalesce(is_correct, false)) AS correct,
           round(count(*) FILTER (coalesce(is_correct, false)) / count(*), 6) AS accuracy,
           round(sum(points), 4) AS total_points,
           round(sum(CASE WHEN is_correct THEN points ELSE 0.0 END), 4) AS earned_points,
           round(sum(CASE WHEN is_correct THEN points ELSE 0.0 END) / sum(points), 6) AS weighted_accuracy
    FROM rows GROUP BY GROUPING SETS (({split}), ())
    """


@query(_accuracy_sql("""
    SELECT d.lang AS split, l.quality = 1 AS is_correct, 1.0::DOUBLE AS points
    FROM documents d LEFT JOIN labels l USING (doc_id)"""))
def accuracy_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy per split and overall; an item without an answer counts as wrong."""
    return _accuracy_columns(summary.accuracy_summary(_document_grades(spark, folder, "left"), []))


@query(_accuracy_sql("""
    SELECT d.lang AS split, l.quality = 1 AS is_correct, 1.0::DOUBLE AS points
    FROM documents d JOIN labels l USING (doc_id)"""))
def accuracy_inner(spark: SparkSession, folder: str) -> DataFrame:
    """The same over answered items only."""
    return _accuracy_columns(summary.accuracy_summary(_document_grades(spark, folder, "inner"), []))


@query("""
    WITH rows AS (
      SELECT l_linestatus AS model, 'c' || l_linenumber AS split, l_returnflag <> 'R' AS ok,
             CASE WHEN l_linenumber = 1 THEN l_quantity ELSE l_quantity / l_linenumber END AS points
      FROM lineitem)
    SELECT model, coalesce(split, 'ALL') AS split, count(*) AS total, count(*) FILTER (ok) AS correct,
           round(count(*) FILTER (ok) / count(*), 6) AS accuracy,
           round(sum(points), 4) AS total_points,
           round(sum(CASE WHEN ok THEN points ELSE 0 END), 4) AS earned_points,
           round(sum(CASE WHEN ok THEN points ELSE 0 END) / sum(points), 6) AS weighted_accuracy
    FROM rows GROUP BY GROUPING SETS ((model, split), (model))
""")
def weighted_points(spark: SparkSession, folder: str) -> DataFrame:
    """Point-weighted accuracy per model and split; points are numbers or fractions in text."""
    quantity = F.col("l_quantity").cast("int").cast("string")
    written = F.when(F.col("l_linenumber") == 1, quantity).otherwise(
        F.concat(quantity, F.lit("/"), text("l_linenumber"))
    )
    rows = table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("model"),
        F.concat(F.lit("c"), text("l_linenumber")).alias("split"),
        (F.col("l_returnflag") != "R").alias("is_correct"),
        tx.points(written).alias("points"),
    )
    rows = rows.withColumn("points_earned", grading.earned("points", "is_correct"))
    out = summary.accuracy_summary(rows, ["model"])
    return _accuracy_columns(out, "model")


@query("""
    WITH rows AS (
      SELECT CASE o_orderstatus WHEN 'F' THEN 'chapter_assignment' ELSE 'chapter_' || o_orderstatus END AS split,
             CASE l_returnflag WHEN 'A' THEN CAST(l_linenumber AS VARCHAR)
                  ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS grp,
             o_orderstatus = 'F' OR l_linestatus = 'O' AS in_scope, l_discount >= 0.05 AS ok, l_quantity AS points
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT coalesce(split, 'ALL') AS split, grp AS assignment_group, count(*) AS total,
           count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) / count(*), 6) AS accuracy,
           round(sum(points), 2) AS total_points, round(sum(CASE WHEN ok THEN points ELSE 0 END), 2) AS earned_points,
           round(sum(CASE WHEN ok THEN points ELSE 0 END) / sum(points), 6) AS weighted_accuracy,
           CAST(grp AS BIGINT) AS group_number
    FROM rows WHERE in_scope GROUP BY GROUPING SETS ((split, grp), (grp))
""")
def group_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores per assignment group inside each split and over all splits."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount"
    )
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    split = F.when(F.col("o_orderstatus") == "F", "chapter_assignment").otherwise(
        F.concat(F.lit("chapter_"), "o_orderstatus")
    )
    quantity = F.col("l_quantity").cast("int").cast("string")
    named = F.concat(F.when(F.col("l_returnflag") == "A", "x").otherwise(""), quantity, F.lit("/a#1"))
    rows = joined.select(
        split.alias("split"),
        lb.assignment_group(
            split, F.when(F.col("l_linestatus") == "O", "assignment").otherwise(""), named, text("l_linenumber")
        ).alias("assignment_group"),
        (F.col("l_discount") >= 0.05).alias("is_correct"),
        F.col("l_quantity").alias("points"),
    )
    rows = rows.withColumn("points_earned", grading.earned("points", "is_correct"))
    return summary.group_scores(rows).select(
        everything("split").alias("split"), "assignment_group", "total", "correct",
        F.round("accuracy", 6).alias("accuracy"), F.round("total_points", 2).alias("total_points"),
        F.round("earned_points", 2).alias("earned_points"), F.round("weighted_accuracy", 6).alias("weighted_accuracy"),
        group_key("assignment_group")["number"].alias("group_number"),
    )


_JUDGE_SQL = """
    judge AS (
      SELECT CAST(conv_id AS VARCHAR) AS id, count(*) FILTER (role = 'assistant') AS a, count(*) AS n,
             max(length(text)) AS longest
      FROM conversations GROUP BY conv_id),
    verdicts AS (
      SELECT id, CASE WHEN n >= 6 THEN NULL ELSE longest > 600 END AS answer_ok, a >= 2 AS reasoning_ok, n FROM judge)"""


def _judge_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """A second grader's verdicts from conversations; long ones give no usable answer verdict."""
    turns = table(spark, folder, "conversations")
    judged = turns.groupBy(text("conv_id").alias("id")).agg(
        F.count_if(F.col("role") == "assistant").alias("a"), F.count("*").alias("n"),
        F.max(F.length("text")).alias("longest"),
    )
    answer = F.when(F.col("n") >= 6, "unsure").when(F.col("longest") > 600, "Yes").otherwise("no")
    return judged.select(
        "id",
        answer.alias("answer_correct"),
        (F.col("a") >= 2).cast("string").alias("reasoning_correct"),
        F.concat(F.lit("turns  "), text("n")).alias("detail"),
        F.lit(" ").alias("judge_reason"), F.concat(F.lit("a"), text("a")).alias("predict_answer"),
        F.lit(None).cast("string").alias("reference_reasoning"), F.lit("r").alias("predict_reasoning"),
    )


def _compared(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        text("doc_id").alias("id"), F.col("text").alias("question"), F.col("source").alias("question_type"),
        F.lit("bool").alias("answer_kind"), F.col("lang").alias("reference_answer"),
    )
    rule = table(spark, folder, "labels").select(
        text("doc_id").alias("id"), text("quality").alias("is_correct"),
        F.when(F.col("toxic") == 1, "toxic").alias("detail"), text("quality").alias("prediction"), F.lit("1").alias("reference"),
    )
    return compare.compare_raters(docs, rule, _judge_verdicts(spark, folder), ["id"])


_COMPARED_SQL = f"""
    WITH {_JUDGE_SQL},
    merged AS (
      SELECT coalesce(d.id, l.id, v.id) AS id, d.lang, d.source, d.text, l.id IS NOT NULL AS rule_exists,
             v.id IS NOT NULL AS llm_exists, l.quality = 1 AS rule_ok, l.toxic, l.quality, v.answer_ok, v.reasoning_ok, v.n, a
      FROM (SELECT CAST(doc_id AS VARCHAR) AS id, * EXCLUDE (doc_id) FROM documents) d
      FULL JOIN (SELECT CAST(doc_id AS VARCHAR) AS id, quality, toxic FROM labels) l ON d.id = l.id
      FULL JOIN (SELECT * FROM verdicts JOIN (SELECT id, a FROM judge) USING (id)) v ON v.id = coalesce(d.id, l.id)),
    compared AS (
      SELECT *, rule_ok IS NOT DISTINCT FROM false AS rule_wrong,
        answer_ok IS NOT DISTINCT FROM false AS llm_wrong_answer,
        reasoning_ok IS NOT DISTINCT FROM false AS llm_wrong_reasoning,
        answer_ok IS NOT DISTINCT FROM false OR reasoning_ok IS NOT DISTINCT FROM false AS llm_any_wrong,
        coalesce(rule_ok = answer_ok, false) AS answer_judgment_same,
        rule_ok IS NOT NULL AND answer_ok IS NOT NULL AND reasoning_ok IS NOT NULL
          AND ((rule_ok AND answer_ok AND reasoning_ok) OR (NOT rule_ok AND NOT answer_ok)) AS overall_judgment_same,
        CASE WHEN NOT rule_exists AND NOT llm_exists THEN 'missing_both' WHEN NOT rule_exists THEN 'missing_rule'
             WHEN NOT llm_exists THEN 'missing_llm' WHEN rule_ok IS NULL THEN 'invalid_rule_result'
             WHEN answer_ok IS NULL OR reasoning_ok IS NULL THEN 'invalid_llm_result'
             WHEN rule_ok AND answer_ok AND reasoning_ok THEN 'same_pass'
             WHEN NOT rule_ok AND NOT answer_ok THEN 'same_fail_answer'
             WHEN rule_ok AND answer_ok THEN 'rule_pass_llm_fail_reasoning'
             WHEN NOT rule_ok AND answer_ok THEN 'rule_fail_llm_pass_answer'
             ELSE 'rule_pass_llm_fail_answer' END AS comparison_note
      FROM merged)"""


@query(f"""
    {_COMPARED_SQL}
    SELECT id, coalesce(source, 'N/A') AS question_type,
           coalesce(nullif(trim(regexp_replace(text, '{WS}', ' ', 'g')), ''), 'N/A') AS question,
           coalesce(lang, 'N/A') AS reference_answer,
           CASE WHEN llm_exists THEN 'a' || a WHEN rule_exists THEN CAST(quality AS VARCHAR) ELSE 'N/A' END AS predict_answer,
           CAST(rule_ok AS VARCHAR) AS rule_is_correct, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'N/A' END AS rule_detail,
           CAST(answer_ok AS VARCHAR) AS llm_answer_correct, CAST(reasoning_ok AS VARCHAR) AS llm_reasoning_correct,
           CASE WHEN llm_exists THEN 'turns ' || n ELSE 'N/A' END AS llm_detail, 'N/A' AS llm_judge_reason,
           rule_wrong, llm_wrong_answer, llm_wrong_reasoning, llm_any_wrong, answer_judgment_same,
           overall_judgment_same, comparison_note
    FROM compared WHERE rule_wrong OR llm_any_wrong
""")
def rater_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Items on which a grader said wrong, with both verdicts and a note."""
    return compare.disagreement_rows(_compared(spark, folder)).select(
        "id", "question_type", "question", "reference_answer", "predict_answer",
        text("rule_is_correct").alias("rule_is_correct"), "rule_detail",
        text("llm_answer_correct").alias("llm_answer_correct"),
        text("llm_reasoning_correct").alias("llm_reasoning_correct"), "llm_detail", "llm_judge_reason", "rule_wrong",
        "llm_wrong_answer", "llm_wrong_reasoning", "llm_any_wrong", "answer_judgment_same",
        "overall_judgment_same", "comparison_note",
    )


@query(f"""
    {_COMPARED_SQL}
    SELECT coalesce(lang, 'ALL') AS split, count(*) AS total_compared,
           count(*) FILTER (r) AS rows_output, count(*) FILTER (r AND rule_wrong) AS rule_wrong_count,
           count(*) FILTER (r AND llm_wrong_answer) AS llm_wrong_answer_count,
           count(*) FILTER (r AND llm_wrong_reasoning) AS llm_wrong_reasoning_count,
           count(*) FILTER (r AND llm_any_wrong) AS llm_any_wrong_count,
           count(*) FILTER (r AND answer_judgment_same) AS answer_judgment_same_count,
           count(*) FILTER (r AND overall_judgment_same) AS overall_judgment_same_count
    FROM (SELECT *, rule_wrong OR llm_any_wrong AS r FROM compared) GROUP BY GROUPING SETS ((lang), ())
""")
def rater_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement counters per split and overall."""
    compared = _compared(spark, folder).withColumn("split", F.col("reference_answer"))
    return compare.agreement_summary(compared).select(everything("split").alias("split"), *compare.COUNTERS)


@query("""
    WITH rows AS (
      SELECT o_orderpriority AS model, o_orderstatus AS split, o_totalprice > 100000 AS ok, o_totalprice > 200000 AS why
      FROM orders)
    SELECT model, coalesce(split, 'ALL') AS split, count(*) AS total, count(*) FILTER (ok) AS correct,
           count(*) FILTER (why) AS reasoning_correct, round(count(*) FILTER (ok) / count(*), 6) AS accuracy,
           round(count(*) FILTER (why) / count(*), 6) AS reasoning_accuracy
    FROM rows GROUP BY GROUPING SETS ((model, split), (model))
""")
def judge_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Judge scores: answers and reasoning, per model and split."""
    rows = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("split"),
        (F.col("o_totalprice") > 100000).alias("answer_correct"), (F.col("o_totalprice") > 200000).alias("reasoning_correct"),
        F.lit(1.0).alias("points"), F.lit(1.0).alias("points_earned"),
    )
    return summary.judge_summary(rows, ["model"]).select(
        "model", everything("split").alias("split"), "total", "correct", "reasoning_correct",
        F.round("accuracy", 6).alias("accuracy"), F.round("reasoning_accuracy", 6).alias("reasoning_accuracy"),
    )


@query("""
    WITH last_turn AS (
      SELECT CAST(conv_id AS VARCHAR) AS id, text, turn FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
    SELECT d.lang AS split, CAST(l.doc_id AS VARCHAR) AS id, 'judge' AS question_type,
           CASE WHEN g.id IS NULL THEN 'text' ELSE 'bool' END AS answer_kind,
           coalesce(CASE WHEN g.turn > 1 THEN 'turn ' || g.turn END, trim(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g'))) AS question,
           coalesce(d.source, '') AS reference_answer, coalesce(CAST(g.turn AS VARCHAR), '') AS predict_answer,
           coalesce(regexp_replace(g.text, '^\\s+|\\s+$', '', 'g'), '') AS model_reasoning, 'toxic' || l.toxic AS rule_detail
    FROM labels l LEFT JOIN documents d USING (doc_id) LEFT JOIN last_turn g ON g.id = CAST(l.doc_id AS VARCHAR)
    WHERE l.quality = 0
""")
def error_export(spark: SparkSession, folder: str) -> DataFrame:
    """Wrong answers with question, reference, answer and reasoning from three tables."""
    docs = items(spark, folder)
    dataset = docs.withColumns({
        "question_type": F.lit("judge"), "answer_kind": F.lit(" "), "reference_answer": F.col("chapter"),
    })
    # (conv_id, turn) is the key of the turns, so the last turn is a maximum.
    turns = table(spark, folder, "conversations").groupBy(text("conv_id").alias("id")).agg(
        F.max_by("text", "turn").alias("model_response"), F.max("turn").alias("turn")
    )
    answers = turns.select(
        "id", "model_response", F.lit("bool").alias("answer_kind"),
        F.when(F.col("turn") > 1, F.concat(F.lit("turn "), text("turn"))).alias("question_final"),
        text("turn").alias("final_answer_for_compare"),
    )
    evals = table(spark, folder, "labels").select(
        text("doc_id").alias("id"), (F.col("quality") == 1).alias("is_correct"),
        F.concat(F.lit("toxic"), text("toxic")).alias("detail"), F.lit("text").alias("answer_kind"),
    )
    rows = grading.error_export(evals, dataset, answers, ["id"])
    return rows.join(docs.select("id", "split"), "id", "left").select(
        "split", "id", "question_type", "answer_kind", "question", "reference_answer", "predict_answer",
        "model_reasoning", "rule_detail",
    )


_LENGTHS_SQL = r"""
    lengths AS (
      SELECT CAST(doc_id AS VARCHAR) AS id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word_count FROM documents),
    ranked AS (SELECT word_count, row_number() OVER (ORDER BY word_count) AS rn, count(*) OVER () // 3 AS third FROM lengths),
    limits AS (
      SELECT max(word_count) FILTER (rn = third) AS short_max, max(word_count) FILTER (rn = 2 * third) AS medium_max FROM ranked),
    binned AS (
      SELECT id, word_count, short_max, medium_max,
             CASE WHEN word_count <= short_max THEN 'Short' WHEN word_count <= medium_max THEN 'Medium' ELSE 'Long' END AS length_bin
      FROM lengths, limits)"""


def _binned(spark: SparkSession, folder: str) -> DataFrame:
    counted = lengths.item_lengths(items(spark, folder), "question_final", ["id"])
    return lengths.with_bins(counted, lengths.tertile_thresholds(counted))


@query(f"""
    WITH {_LENGTHS_SQL}
    SELECT id, CAST(word_count AS INT) AS word_count, length_bin, CAST(short_max AS INT) AS short_max,
           CAST(medium_max AS INT) AS medium_max FROM binned
""")
def length_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Word count and tertile bin of every item."""
    return _binned(spark, folder).select("id", "word_count", "length_bin", "short_max", "medium_max")


@query(f"""
    WITH {_LENGTHS_SQL}
    SELECT b.length_bin, count(id) AS n FROM (VALUES ('Short'), ('Medium'), ('Long')) b(length_bin)
    LEFT JOIN binned USING (length_bin) GROUP BY 1
""")
def length_bin_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Items per bin, empty bins included."""
    return lengths.bin_counts(_binned(spark, folder))


@query(f"""
    WITH {_LENGTHS_SQL},
    evals AS (
      SELECT CAST(doc_id AS VARCHAR) AS id, 'quality' AS model, quality = 1 AS ok FROM labels
      UNION ALL SELECT CAST(doc_id AS VARCHAR), 'toxic', toxic = 0 FROM labels
      UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'orders', o_orderstatus = 'F' FROM orders),
    models AS (SELECT DISTINCT model FROM evals),
    joined AS (SELECT e.model, e.ok, b.length_bin FROM evals e LEFT JOIN binned b USING (id)),
    totals AS (
      SELECT model, count(*) FILTER (length_bin IS NULL) AS extra, count(*) FILTER (length_bin IS NOT NULL) AS matched
      FROM joined GROUP BY 1),
    bins AS (SELECT * FROM (VALUES ('Short', 1), ('Medium', 2), ('Long', 3)) t(length_bin, bin_order)),
    counts AS (
      SELECT m.model, b.length_bin, b.bin_order, count(j.model) AS total, count(j.model) FILTER (j.ok) AS correct
      FROM models m CROSS JOIN bins b LEFT JOIN joined j ON j.model = m.model AND j.length_bin = b.length_bin GROUP BY ALL)
    SELECT model, length_bin, bin_order,
           CASE length_bin WHEN 'Short' THEN 'Short ($\\le ' || short_max || '$ words)'
                WHEN 'Medium' THEN 'Medium (' || (short_max + 1) || '--' || medium_max || ' words)'
                ELSE 'Long ($>' || medium_max || '$ words)' END AS bin_label,
           total, correct, round(correct / total, 6) AS accuracy,
           (SELECT count(*) FROM lengths) - matched AS missing_eval_count, extra AS extra_eval_count
    FROM counts JOIN totals USING (model), limits
""")
def length_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy per model and length bin, with missing and extra ids per model."""
    orders = table(spark, folder, "orders").select(
        F.lit("orders").alias("model"), text("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("is_correct")
    )
    evals = label_verdicts(spark, folder).unionByName(orders)
    return lengths.length_breakdown(_binned(spark, folder), evals).select(
        "model", "length_bin", "bin_order", "bin_label", "total", "correct",
        F.round("accuracy", 6).alias("accuracy"), "missing_eval_count", "extra_eval_count",
    )


@query(f"""
    WITH {_LENGTHS_SQL}, wanted AS (SELECT m.model, b.* FROM binned b, (VALUES ('quality'), ('toxic')) m(model)),
    evals AS (
      SELECT CAST(doc_id AS VARCHAR) AS id, 'quality' AS model, quality = 1 AS ok FROM labels
      UNION ALL SELECT CAST(doc_id AS VARCHAR), 'toxic', toxic = 0 FROM labels)
    SELECT model, id, length_bin, CAST(ok AS VARCHAR) AS is_correct,
           CASE WHEN ok IS NULL THEN 'missing_rule_evaluation' ELSE 'graded' END AS detail
    FROM wanted LEFT JOIN evals USING (model, id)
""")
def length_item_results(spark: SparkSession, folder: str) -> DataFrame:
    """One row per model and item, missing evaluations included."""
    evals = label_verdicts(spark, folder).withColumn("detail", F.lit("graded"))
    rows = lengths.item_results(_binned(spark, folder), evals, ["quality", "toxic"])
    return rows.select("model", "id", "length_bin", text("is_correct").alias("is_correct"), "detail")


def _configured_evals(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as evaluation rows of configurations; the part is the item."""
    lines = table(spark, folder, "lineitem")
    return lines.select(
        F.col("l_partkey").alias("id"), F.col("l_linestatus").alias("family"), text("l_linenumber").alias("variant"),
        F.concat_ws("-", "l_linestatus", text("l_linenumber"), "l_returnflag").alias("model"),
        (F.col("l_discount") >= 0.05).alias("is_correct"),
    )


_CATEGORY_SQL = """
    WITH counts AS (
      SELECT l_linestatus AS family, CAST(l_linenumber AS VARCHAR) AS variant,
             l_linestatus || '-' || l_linenumber || '-' || l_returnflag AS model, p_type AS label,
             count(*) AS total, count(*) FILTER (l_discount >= 0.05) AS correct
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    accuracy AS (
      SELECT *, correct / total * 100.0 AS accuracy_pct,
             sum(correct) OVER w / sum(total) OVER w * 100.0 AS overall_accuracy_pct
      FROM counts WINDOW w AS (PARTITION BY family, variant, model))"""


def _category_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label"))
    return categories.category_accuracy(_configured_evals(spark, folder), labels)


@query(f"""
    {_CATEGORY_SQL}
    SELECT family, variant, model, label, total, correct, round(accuracy_pct, 6) AS accuracy_pct,
           round(overall_accuracy_pct, 6) AS overall_accuracy_pct FROM accuracy
""")
def category_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy per configuration and category, with the configuration's overall accuracy."""
    return _category_accuracy(spark, folder).select(
        "family", "variant", "model", "label", "total", "correct",
        F.round("accuracy_pct", 6).alias("accuracy_pct"), F.round("overall_accuracy_pct", 6).alias("overall_accuracy_pct"),
    )


@query(f"""
    {_CATEGORY_SQL}
    SELECT family, variant, label, round(avg(accuracy_pct), 6) AS macro_accuracy_pct, count(*) AS configs
    FROM accuracy GROUP BY 1, 2, 3
""")
def macro_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Unweighted mean over the configurations of a variant."""
    macro = categories.macro_accuracy(_category_accuracy(spark, folder))
    return macro.withColumn("macro_accuracy_pct", F.round("macro_accuracy_pct", 6))


@query("""
    SELECT label, rank, (SELECT count(*) FROM part WHERE p_type = label) AS n
    FROM (VALUES ('SMALL', 1), ('MEDIUM', 2), ('LARGE', 3), ('HUGE', 4)) t(label, rank)
""")
def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Items per category in a fixed order, empty categories included."""
    labels = table(spark, folder, "part").select(F.col("p_type").alias("label"))
    return categories.category_counts(labels, ["SMALL", "MEDIUM", "LARGE", "HUGE"])


@query("""
    SELECT p_brand AS family, p_type AS effort, CAST(p_size AS BIGINT) AS max_tokens, p_name || '#' || p_partkey AS model
    FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_name || '#' || p_partkey) = 1
""")
def best_config(spark: SparkSession, folder: str) -> DataFrame:
    """Largest budget per family and effort, ties by name."""
    configs = table(spark, folder, "part").select(
        F.col("p_brand").alias("family"), F.col("p_type").alias("effort"),
        F.col("p_size").cast("bigint").alias("max_tokens"),
        F.concat_ws("#", "p_name", text("p_partkey")).alias("model"),
    )
    return categories.representative_configs(configs)


@query("""
    WITH t AS (
      SELECT d.lang AS model, l.toxic, l.quality, d.source FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 0 OR l.toxic = 1)
    SELECT model, 'detail' AS dimension, CASE toxic WHEN 1 THEN 'toxic' ELSE 'unknown' END AS value, count(*) AS n FROM t GROUP BY ALL
    UNION ALL SELECT model, 'question_type', CAST(quality AS VARCHAR), count(*) FROM t GROUP BY ALL
    UNION ALL SELECT model, 'chapter', source, count(*) FROM t GROUP BY ALL
""")
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Detail, question type and chapter counts of wrong answers per model."""
    labels = table(spark, folder, "labels").filter((F.col("quality") == 0) | (F.col("toxic") == 1))
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    rows = labels.join(docs, "doc_id").select(
        F.col("lang").alias("model"), F.when(F.col("toxic") == 1, "toxic").otherwise(" ").alias("detail"),
        text("quality").alias("question_type"), F.col("source").alias("chapter"),
    )
    return summary.value_counts(rows, ["model"], ["detail", "question_type", "chapter"])


@query("""
    SELECT d.lang AS split, count(*) AS judge_total, count(*) FILTER (l.quality = 1) AS "true",
           count(*) FILTER (l.quality = 0) AS "false", count(*) FILTER (l.quality IS NULL) AS unknown
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1
""")
def label_balance(spark: SparkSession, folder: str) -> DataFrame:
    """True, false and unknown labels among judge questions per split."""
    labels = table(spark, folder, "labels").select("doc_id", tx.answer_bool(text("quality")).alias("label"))
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("split"))
    rows = docs.join(labels, "doc_id", "left").withColumn("question_type", F.lit(" Judge "))
    return summary.label_balance(rows, ["split"])


@query("""
    SELECT d.lang AS split, count(*) AS stage1, count(l.doc_id) AS stage2,
           count(*) FILTER (l.quality = 1) AS stage3, count(*) FILTER (l.quality = 1 AND l.toxic = 0) AS final
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1
""")
def stage_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per split in each stage of a build."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("split"))
    labelled = docs.join(table(spark, folder, "labels"), "doc_id")
    return summary.stage_counts({
        "stage1": docs, "stage2": labelled, "stage3": labelled.filter("quality = 1"),
        "final": labelled.filter("quality = 1 AND toxic = 0"),
    })


@query("""
    SELECT CAST(o_custkey AS VARCHAR) AS id, 'missing' AS side FROM (SELECT DISTINCT o_custkey FROM orders)
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL
    SELECT CAST(c_custkey AS VARCHAR), 'extra' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def id_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Ids on one side only: customers of orders against the customer table."""
    ordered = table(spark, folder, "orders").select(text("o_custkey").alias("id"))
    known = table(spark, folder, "customer").select(text("c_custkey").alias("id"))
    return merge.id_difference(ordered, known)

