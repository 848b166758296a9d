"""The dataset chain: source problems to evaluation items in five stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.operators import build, rebalance, scoring
from sparkgrade.operators.summary import stage_counts
from sparkgrade.session import cut_lineage, rows_at_once

Scorer = Callable[[], Callable[[str], str]]

#: Requests that a task sends to its scorers at a time.
BATCH = 500

#: Columns that tables are joined and counted by; they stay columns of their own on disk.
KEYS = ("split", "id", "reply_status")


@dataclass
class Dataset:
    stage1: DataFrame
    stage2: DataFrame
    stage3: DataFrame
    items: DataFrame

    def counts(self) -> DataFrame:
        return stage_counts({
            "stage1": self.stage1, "stage2": self.stage2, "stage3": self.stage3, "final": self.items,
        })


def called(
    rows: DataFrame, request: Column, scorer: Scorer, threads: int,
    accept: Callable[[str], bool] = scoring.is_object, attempts: int = 3,
) -> DataFrame:
    """Rows with the scorer's ``reply`` and ``reply_status``, to be written before they are used
    twice. Replies that ``accept`` refuses are asked for again; NULL or the last refused reply
    is a failure."""
    return rows.withColumn("_scored", scoring.score(request, scorer, attempts, threads, accept)).select(
        "*", F.col("_scored.response").alias("reply"), F.col("_scored.status").alias("reply_status")
    ).drop("_scored")


def ask(
    rows: DataFrame, request: Column, scorer: Scorer, name: str, threads: int,
    accept: Callable[[str], bool] = scoring.is_object, attempts: int = 3,
) -> DataFrame:
    """:func:`called`, written once. A row holds its question several times over, and so do the
    parts of one question."""
    scored = called(rows, request, scorer, threads, accept, attempts)
    texts = [f.name for f in scored.schema if f.dataType.simpleString() == "string" and f.name not in KEYS]
    with rows_at_once(rows.sparkSession, BATCH):
        return cut_lineage(scored, name, texts)


def check_references(problems: DataFrame, scorer: Scorer, cache: DataFrame | None = None, threads: int = 4) -> DataFrame:
    """Stage 1. Cached rows that hold a reply are reused, all others are asked."""
    if cache is not None:
        usable = cache.filter(~F.coalesce("llm_json", F.lit("{}")).isin("", "{}"))
        usable = usable.join(problems.select("split", "id"), ["split", "id"], "left_semi")
        problems = problems.join(usable.select("split", "id"), ["split", "id"], "left_anti")
    asked = ask(problems, build.reference_request(), scorer, "stage1", threads)
    rows = build.reference_rows(asked.drop("reply_status"))
    return rows if cache is None else rows.unionByName(usable.select(*rows.columns))


def split_questions(stage1: DataFrame, scorer: Scorer, threads: int = 4) -> DataFrame:
    """Stage 2."""
    return build.split_rows(ask(stage1, build.split_request(), scorer, "stage2", threads).drop("reply_status"))


def convert_items(stage2: DataFrame, scorer: Scorer, aligner: Scorer, threads: int = 4) -> DataFrame:
    """Stage 3, with one repair of items that break their symbol contract, then alignment."""
    parts = build.explode_pairs(stage2)
    first = called(parts, build.convert_request(), scorer, threads).drop("reply_status")
    hinted = build.convert_rows(first.withColumn("_first", F.col("reply"))).withColumn("_hint", build.repair_hint())
    hinted = hinted.select(*parts.columns, "_first", "_hint")
    # Both calls for a row are made before it is written. A NULL request is skipped: rows that
    # passed keep their reply, and their place beside the other parts of their question.
    again = F.when(F.col("_hint").isNotNull(), build.convert_request(F.col("_hint")))
    asked = ask(hinted, again, scorer, "stage3", threads).drop("reply_status")
    asked = asked.withColumns({
        "reply": F.when(F.col("_hint").isNull(), F.col("_first")).otherwise(F.col("reply")),
        "stage3_retry_count": F.col("_hint").isNotNull().cast("int"),
    })
    rows = build.convert_rows(asked.drop("_first", "_hint"))
    return build.sync_rows(ask(rows, build.sync_request(), aligner, "aligned", threads))


def build_dataset(
    problems: DataFrame, checker: Scorer, splitter: Scorer, converter: Scorer, aligner: Scorer,
    cache: DataFrame | None = None, threads: int = 4,
) -> Dataset:
    """All stages. Replies are written as they come; a stage table is a projection of them."""
    stage1 = check_references(problems, checker, cache, threads)
    stage2 = split_questions(stage1, splitter, threads)
    stage3 = convert_items(stage2, converter, aligner, threads)
    return Dataset(stage1, stage2, stage3, build.dataset_rows(stage3))


def rebalance_judges(items: DataFrame, rewriter: Scorer, seed: int = 42, threads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Balanced items and the label counts before and after."""
    labelled = items.withColumns({
        "label": rebalance.judge_label(items.columns), "_text": rebalance.question_text(items.columns),
    })
    planned = rebalance.rebalance_plan(labelled, seed).filter("_text != ''").select("split", "id", "label", "_text")
    request = F.concat(
        F.lit("Rewrite the question so that its label flips. Label: "), F.col("label"), F.lit("\n"), F.col("_text")
    )
    asked = ask(planned, request, rewriter, "rewrites", threads, rebalance.usable_rewrite)
    balanced = rebalance.apply_flips(items, rebalance.accepted_rewrites(asked, "reply"))
    return balanced, rebalance.rebalance_report(items, balanced)
