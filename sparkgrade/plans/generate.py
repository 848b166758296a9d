"""Answer generation around a user's callable."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrade import schemas
from sparkgrade.functions import symbols as sy
from sparkgrade.operators import generation, grading, merge, overlay, provenance, scoring
from sparkgrade.operators.keys import head_per_group, keep_ids
from sparkgrade.session import cut_lineage

KEYS = ["split", "id"]


@dataclass
class Generation:
    rows: DataFrame
    failures: DataFrame
    calls: DataFrame


def requests(dataset: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Items with their request column and the fields the answer rows carry on."""
    items = schemas.complete(dataset, schemas.DATASET, schemas.OVERLAY)
    if entries is not None:
        items = overlay.apply_overrides(
            items.drop(*[f.name for f in schemas.struct(schemas.OVERLAY).fields]), entries
        )
    items = items.withColumns({
        "question_final_used": overlay.effective_question(),
        "answer_kind": grading.answer_kind("answer_kind"),
        "comparison_mode": grading.comparison_mode("comparison_mode", "answer_kind"),
        "symbol_contract_allowed_symbols": sy.resolve_allowed(
            "symbol_contract_allowed_symbols", "symbol_contract", "reference_answer_sympy"
        ),
        "reference_answer": overlay.effective_reference(),
        "reference_answer_sympy": overlay.effective_symbolic(),
    })
    request = generation.solve_request(
        "question_final_used", "answer_kind", "symbol_contract_allowed_symbols",
        F.array_sort(F.coalesce(F.map_keys("reference_answer_json"), F.array().cast("array<string>"))),
    )
    return items.withColumn("request", request)


def preview(dataset: DataFrame, per_split: int = 3) -> DataFrame:
    """Dry run: a few requests of each split, nothing is called."""
    return head_per_group(requests(dataset), ["split"], [F.asc("id")], per_split).select(*KEYS, "request")


def generate(
    dataset: DataFrame,
    model: str,
    solver: Callable[[], Callable[[str], str]],
    converter: Callable[[], Callable[[str], str]] | None = None,
    done: DataFrame | None = None,
    ids: DataFrame | None = None,
    entries: DataFrame | None = None,
    tasks: int | None = None,
    threads: int = 8,
    max_attempts: int = 1,
    ledger: str | None = None,
) -> Generation:
    """Answer the items that have no answer yet, or exactly the named ones.

    ``rows`` are new answers, ``failures`` the dead letters, ``calls`` one row per
    attempt. Invalidate evaluations of the answered ids with ``merge.drop_evaluations``. With a
    ``ledger`` folder, replies outlive failed tasks and runs (:func:`scoring.score_once`).
    """
    wanted = keep_ids(dataset, ids)
    if ids is None and done is not None:
        wanted = merge.pending_rows(wanted, done)
    asked = requests(wanted, entries)
    if ledger is not None:
        scored = scoring.score_once(asked, "request", solver, ledger, max_attempts, threads)
    else:
        scored = scoring.spread(asked, tasks).withColumn("scored", scoring.score("request", solver, max_attempts, threads))
    scored = cut_lineage(scored, "answers")
    answered = scoring.succeeded(scored).withColumn("model_response", F.col("scored.response"))
    if converter is not None:
        first = generation.process_responses(answered)
        second = first.withColumn("converted", scoring.score(
            generation.conversion_request(F.col("answer_boxed"), F.col("answer_kind"), F.col("comparison_mode")),
            converter, max_attempts, threads,
        ))
        second = cut_lineage(second, "converted")
        rows = generation.process_responses(second, F.col("converted.response")).drop("converted")
    else:
        rows = generation.process_responses(answered)
    rows = provenance.stamp(rows.drop("scored", "request").withColumn("model", F.lit(model)), "generate", model)
    return Generation(rows, scoring.dead_letters(scored, KEYS), scoring.call_log(scored, KEYS))
