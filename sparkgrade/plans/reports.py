"""Report jobs: length breakdown, wrong keywords, categories, reruns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.operators import categories, keywords, lengths, rerun, summary
from sparkgrade.operators.keys import common_ids, only_in, require_unique
from sparkgrade.session import cut_lineage


@dataclass
class LengthReport:
    lengths: DataFrame
    bins: DataFrame
    breakdown: DataFrame


def length_report(
    dataset: DataFrame,
    evals: DataFrame,
    question: Column | str,
    keys: Sequence[str] = ("id",),
    short_max: int | None = None,
    medium_max: int | None = None,
) -> LengthReport:
    """Accuracy by question length, with exact tertiles or given limits.

    Word counts are written once: the texts are read a single time, and thresholds, bins
    and breakdown work on a key and a number per item.
    """
    counted = cut_lineage(lengths.item_lengths(dataset, question, keys), "lengths")
    require_unique(counted, keys)
    if short_max is not None and medium_max is not None:
        low, high = lengths.fixed_thresholds(counted, short_max, medium_max)
        binned = counted.withColumns({"short_max": low, "medium_max": high}).withColumn(
            "length_bin", lengths.length_bin("word_count", low, high)
        )
    else:
        binned = lengths.with_bins(counted, lengths.tertile_thresholds(counted))
    return LengthReport(binned, lengths.bin_counts(binned), lengths.length_breakdown(binned, evals, keys))


@dataclass
class KeywordReport:
    stats: DataFrame
    top: DataFrame
    links: DataFrame
    counts: DataFrame


def keyword_report(
    dataset: DataFrame,
    evals: DataFrame,
    question: Column | str,
    selected: Sequence[str] | None = None,
    top_k: int = 3,
    min_wrong: int = 1,
    keep_generic_terms: bool = False,
    keys: Sequence[str] = ("split", "id"),
) -> KeywordReport:
    """Phrases that occur more often in wrongly answered questions than overall.

    ``selected`` reports exactly those keywords; ``None`` finds, prunes and ranks them.
    The phrases of wrongly answered questions are written once and serve all parts of the report;
    those of all questions are counted where the texts are read, and never written or moved whole.
    """
    found = keywords.question_phrases(dataset, question, keys, **keywords.default_word_lists(keep_generic_terms))
    wrong = evals.filter(~F.coalesce("is_correct", F.lit(False))).filter(F.col("id") != "")
    held = cut_lineage(keywords.wrong_questions(found, wrong, keys), "wrong-phrases")
    if selected:
        stats = keywords.keyword_stats(found, wrong, min_wrong, selected, keys, held)
        top = stats
    else:
        counts = cut_lineage(keywords.wrong_counts(held, min_wrong), "wrong-counts")
        stats = cut_lineage(keywords.keyword_stats(found, wrong, min_wrong, None, keys, held, counts), "keywords")
        stats = keywords.prune_nested(stats, found, wrong, keys, held=held)
        top = keywords.top_keywords(stats, top_k)
    links = keywords.keyword_links(top, found, wrong, dataset, question, keys, held=held)
    known = wrong.join(dataset.select(*keys), list(keys), "left_semi")
    counts = summary.value_counts(known, ["model"], [c for c in ("detail", "question_type", "split") if c in known.columns])
    return KeywordReport(stats, top, links, counts)


def category_report(evals: DataFrame, labels: DataFrame, api_families: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Category accuracy over the items every model answered, and its macro average.

    ``evals`` has ``family, variant, effort, max_tokens, model, id, is_correct``.
    """
    shared = evals.join(common_ids(evals), "id", "left_semi")
    best = categories.representative_configs(shared, api_families).select("model")
    accuracy = categories.category_accuracy(only_in(shared, best, "model"), labels)
    return accuracy, categories.macro_accuracy(accuracy)


def selected_category_report(evals: DataFrame, labels: DataFrame, models: Sequence[str]) -> DataFrame:
    """Category accuracy of one named configuration per family."""
    return categories.category_accuracy(evals.filter(F.col("model").isin(list(models))), labels)


def token_limit_report(
    answers: DataFrame,
    calls: DataFrame,
    default_budget: int,
    order: Sequence[Column | str] = ("date", "_pos"),
    ratio: float = rerun.MIN_TOKEN_RATIO,
    absolute: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answers cut off by their token budget, and the funnel that led to them."""
    missing = rerun.missing_final_answer("model_response", "answer_boxed", "final_answer_for_compare")
    # Only unanswered rows are looked up in the call log.
    costed = rerun.attach_cost(answers.filter(missing), rerun.solve_calls(calls), order)
    whole = costed.unionByName(answers.filter(~missing), allowMissingColumns=True)
    classified = rerun.token_limit_status(whole, default_budget, ratio, absolute)
    return rerun.token_limit_rows(classified), rerun.token_limit_funnel(classified)
