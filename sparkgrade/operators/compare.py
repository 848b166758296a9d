"""Two graders side by side: verdict labels, row comparison, agreement counters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions import text as tx
from sparkgrade.operators.keys import latest

COUNTERS = [
    "total_compared", "rows_output", "rule_wrong_count", "llm_wrong_answer_count",
    "llm_wrong_reasoning_count", "llm_any_wrong_count", "answer_judgment_same_count",
    "overall_judgment_same_count",
]


def verdict_detail(answer_correct: Column, reasoning_correct: Column) -> Column:
    return (
        F.when(answer_correct & reasoning_correct, "ok")
        .when(~answer_correct & reasoning_correct, "wrong_answer")
        .when(answer_correct & ~reasoning_correct, "bad_reasoning")
        .otherwise("both_wrong")
    )


def comparison_note(
    rule_exists: Column, judge_exists: Column, rule_ok: Column, answer_ok: Column, reasoning_ok: Column
) -> Column:
    """What the two graders say about one item; the order of the tests matters."""
    return (
        F.when(~rule_exists & ~judge_exists, "missing_both")
        .when(~rule_exists, "missing_rule")
        .when(~judge_exists, "missing_llm")
        .when(rule_ok.isNull(), "invalid_rule_result")
        .when(answer_ok.isNull() | reasoning_ok.isNull(), "invalid_llm_result")
        .when(rule_ok & answer_ok & reasoning_ok, "same_pass")
        .when(~rule_ok & ~answer_ok, "same_fail_answer")
        .when(rule_ok & answer_ok & ~reasoning_ok, "rule_pass_llm_fail_reasoning")
        .when(~rule_ok & answer_ok, "rule_fail_llm_pass_answer")
        .when(rule_ok & ~answer_ok, "rule_pass_llm_fail_answer")
        .otherwise("different")
    )


def align_by_key(sources: dict[str, DataFrame], keys: Sequence[str], pos: str | None = None) -> DataFrame:
    """Full outer join of any number of tables on one key, in one shuffle.

    Each source becomes a struct column of its other fields (NULL when it has no such
    row); of repeated rows the last by ``pos`` counts, or by ``_pos`` where a source has it;
    other sources must not repeat keys. Aggregating the tagged union
    combines copies of a key before the shuffle, where chained outer joins would
    shuffle the growing result again for every source.
    """
    tagged = []
    for name, df in sources.items():
        for key in keys:
            df = df.filter(tx.blank_to_null(F.col(key).cast("string")).isNotNull())
        df = latest(df, keys, pos)
        fields = [c for c in df.columns if c not in keys]
        tagged.append(df.select(*keys, F.struct(*fields).alias(name)))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)

    return union.groupBy(*keys).agg(*[F.first(name, ignorenulls=True).alias(name) for name in sources])


def compare_raters(
    dataset: DataFrame, rule: DataFrame, judge: DataFrame, keys: Sequence[str] = ("split", "id"), pos: str | None = None
) -> DataFrame:
    """One row per item known to any of the three tables, with both verdicts and a note.

    ``dataset`` brings ``question, question_type, answer_kind, reference_answer``;
    ``rule`` ``is_correct, detail, prediction, reference``; ``judge``
    ``answer_correct, reasoning_correct, detail, judge_reason, predict_answer,
    reference_reasoning, predict_reasoning``.
    """
    rows = align_by_key({"ds": dataset, "rule": rule, "judge": judge}, keys, pos)
    rule_exists, judge_exists = F.col("rule").isNotNull(), F.col("judge").isNotNull()
    rule_ok = tx.loose_bool(F.col("rule.is_correct"))
    answer_ok = tx.loose_bool(F.col("judge.answer_correct"))
    reasoning_ok = tx.loose_bool(F.col("judge.reasoning_correct"))
    named = rows.select(
        *keys,
        tx.clean_text(F.col("ds.question_type")).alias("question_type"),
        tx.clean_text(F.col("ds.answer_kind")).alias("answer_kind"),
        tx.clean_text(F.col("ds.question")).alias("question"),
        tx.clean_text(F.col("ds.reference_answer")).alias("reference_answer"),
        F.when(judge_exists, tx.clean_text(F.col("judge.predict_answer")))
        .otherwise(tx.clean_text(F.col("rule.prediction"))).alias("predict_answer"),
        rule_ok.alias("rule_is_correct"),
        tx.clean_text(F.col("rule.detail")).alias("rule_detail"),
        tx.clean_text(F.col("rule.prediction")).alias("rule_prediction"),
        tx.clean_text(F.col("rule.reference")).alias("rule_reference"),
        answer_ok.alias("llm_answer_correct"),
        reasoning_ok.alias("llm_reasoning_correct"),
        tx.clean_text(F.col("judge.detail")).alias("llm_detail"),
        tx.clean_text(F.col("judge.judge_reason")).alias("llm_judge_reason"),
        tx.clean_text(F.col("judge.reference_reasoning")).alias("llm_reference_reasoning"),
        tx.clean_text(F.col("judge.predict_reasoning")).alias("llm_predict_reasoning"),
        rule_exists.alias("rule_exists"),
        judge_exists.alias("llm_exists"),
    )
    rule_ok, answer_ok, reasoning_ok = (
        F.col("rule_is_correct"), F.col("llm_answer_correct"), F.col("llm_reasoning_correct"),
    )
    # A NULL verdict is neither right nor wrong.
    wrong_answer, wrong_reasoning = answer_ok.eqNullSafe(False), reasoning_ok.eqNullSafe(False)
    both_right = rule_ok & answer_ok & reasoning_ok
    known = rule_ok.isNotNull() & answer_ok.isNotNull() & reasoning_ok.isNotNull()
    return named.withColumns({
        "rule_wrong": rule_ok.eqNullSafe(False),
        "llm_wrong_answer": wrong_answer,
        "llm_wrong_reasoning": wrong_reasoning,
        "llm_any_wrong": wrong_answer | wrong_reasoning,
        "answer_judgment_same": F.coalesce(rule_ok == answer_ok, F.lit(False)),
        "overall_judgment_same": known & F.coalesce(both_right | (~rule_ok & ~answer_ok), F.lit(False)),
        "comparison_note": comparison_note(
            F.col("rule_exists"), F.col("llm_exists"), rule_ok, answer_ok, reasoning_ok
        ),
    })


def disagreement_rows(compared: DataFrame) -> DataFrame:
    """Rows some grader marked wrong: the comparison report."""
    return compared.filter(F.col("rule_wrong") | F.col("llm_any_wrong")).drop("rule_exists", "llm_exists")


def agreement_summary(compared: DataFrame, split: str = "split") -> DataFrame:
    """Eight counters per split and overall; all but the first look at reported rows only."""
    reported = F.col("rule_wrong") | F.col("llm_any_wrong")

    def count(flag: str) -> Column:
        return F.count_if(reported & F.col(flag)).alias(f"{flag}_count")

    parts = compared.groupBy(split).agg(
        F.count("*").alias("total_compared"),
        F.count_if(reported).alias("rows_output"),
        *[count(f) for f in (
            "rule_wrong", "llm_wrong_answer", "llm_wrong_reasoning", "llm_any_wrong",
            "answer_judgment_same", "overall_judgment_same",
        )],
    )
    return parts.rollup(split).agg(
        F.when(F.grouping(split) == 1, "overall").otherwise("split").alias("level"),
        *[F.sum(c).alias(c) for c in COUNTERS],
    )
