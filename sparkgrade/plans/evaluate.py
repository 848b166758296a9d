"""Evaluation jobs: rule grading, judge grading, comparison, error export."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrade.operators import compare, grading, judging, merge, overlay, provenance, scoring, summary
from sparkgrade.operators.keys import keep_ids, latest, only_in
from sparkgrade.session import cut_lineage

KEYS = ["split", "id"]


@dataclass
class Evaluation:
    """Rows of an evaluation and its score tables."""

    rows: DataFrame
    summary: DataFrame
    groups: DataFrame


def _latest(df: DataFrame, pos: str | None) -> DataFrame:
    named = latest(df.withColumn("id", F.trim("id")).filter("id != ''"), KEYS, pos)
    return named.drop(pos or "_pos")


def _to_grade(dataset: DataFrame, existing: DataFrame | None, ids: DataFrame | None, force: bool) -> DataFrame:
    """Items to grade now: all, the named ones, or those without a result."""
    if ids is not None:
        return keep_ids(dataset, ids)
    if existing is None or force:
        return dataset
    return merge.pending_rows(dataset, existing)


def _merged(new: DataFrame, existing: DataFrame | None, dataset: DataFrame, ids: DataFrame | None, force: bool) -> DataFrame:
    """New results plus the old ones that still count.

    Old rows of named ids go first, even when no new row follows; rows whose item left
    the dataset are dropped. Old and new keys are disjoint, so a union is enough.
    """
    if existing is None or (force and ids is None):
        return new
    kept = existing.join(dataset.select(*KEYS), KEYS, "left_semi")
    if ids is not None:
        kept = kept.join(ids.select("id"), "id", "left_anti")
    else:
        kept = kept.join(new.select(*KEYS), KEYS, "left_anti")
    return new.unionByName(kept, allowMissingColumns=True)


def rule_evaluation(
    dataset: DataFrame,
    answers: DataFrame,
    model: str,
    entries: DataFrame | None = None,
    existing: DataFrame | None = None,
    ids: DataFrame | None = None,
    force: bool = False,
    include_missing: bool = True,
    pos: str | None = None,
) -> Evaluation:
    """Grade one artifact's answers by rule.

    ``entries`` are reviewer overrides, ``existing`` the stored results of an earlier
    run, ``ids`` limits the run to some items. Of repeated rows the last by ``pos`` counts
    (by ``_pos`` if not named); tables without a row order must not repeat keys.
    """
    items = _latest(dataset, pos)
    if entries is not None:
        items = overlay.apply_overrides(items, entries)
    wanted = _to_grade(items, existing, ids, force)
    joined = grading.grade_join(wanted, _latest(answers, pos), include_missing=include_missing)
    graded = grading.grade(joined).withColumn("model", F.lit(model))
    graded = provenance.stamp(graded, "evaluate", model)
    rows = cut_lineage(_merged(graded, existing, items, ids, force), "rule_eval")
    return Evaluation(rows, summary.accuracy_summary(rows), summary.group_scores(rows))


def judge_evaluation(
    dataset: DataFrame,
    answers: DataFrame,
    model: str,
    judge_model: str,
    judge: Callable[[], Callable[[str], str]],
    entries: DataFrame | None = None,
    existing: DataFrame | None = None,
    ids: DataFrame | None = None,
    force: bool = False,
    pos: str | None = None,
    tasks: int | None = None,
    threads: int = 4,
) -> Evaluation:
    """Grade one artifact's answers by a judge callable that replies with JSON."""
    items = _latest(dataset, pos)
    if entries is not None:
        items = overlay.apply_overrides(items, entries)
    wanted = _to_grade(items, existing, ids, force)
    asked = scoring.spread(judging.judge_join(wanted, _latest(answers, pos)), tasks)
    scored = cut_lineage(asked.withColumn("scored", scoring.score("request", judge, 3, threads, judging.usable_reply)), "judged")
    judged = judging.judged_rows(scored, F.col("scored.response")).drop("scored")
    judged = provenance.stamp(judged, "evaluate-llm", model, judge_model).withColumn("model", F.lit(model))
    rows = cut_lineage(_merged(judged, existing, items, ids, force), "judge_eval")
    groups = summary.group_scores(rows.withColumn("is_correct", F.col("answer_correct")))
    return Evaluation(rows, summary.judge_summary(rows), groups)


def rater_comparison(dataset: DataFrame, rule: DataFrame, judge: DataFrame, pos: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows on which a grader said wrong, and the agreement counters."""
    compared = cut_lineage(compare.compare_raters(dataset, rule, judge, KEYS, pos), "compared")
    return compare.disagreement_rows(compared), compare.agreement_summary(compared)


def export_errors(
    evals: DataFrame, dataset: DataFrame, answers: DataFrame, ids: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Wrong answers with their context, and how many each split has."""
    rows = grading.error_export(keep_ids(evals, ids), dataset, answers)
    counts = keep_ids(evals, ids).filter(~F.coalesce("is_correct", F.lit(False))).groupBy("split").agg(
        F.count("*").alias("errors")
    )
    return rows, counts


def prune_artifacts(
    artifacts: dict[str, DataFrame], dataset: DataFrame, dry_run: bool = False
) -> dict[str, DataFrame]:
    """Each table without the rows of items that left the dataset, or with the plan only.

    Summaries are recomputed from the pruned tables, never edited.
    """
    step = merge.prune_plan if dry_run else merge.prune
    return {name: step(df, dataset) for name, df in artifacts.items()}


def rebuild_summaries(pruned: dict[str, DataFrame], removed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """New score tables for the models that lost rows."""
    out = {}
    for name, df in pruned.items():
        touched = only_in(df, removed[name], "model")
        build = summary.judge_summary if "answer_correct" in df.columns else summary.accuracy_summary
        out[name] = build(touched)
    return out
