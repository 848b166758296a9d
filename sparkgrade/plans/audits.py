"""Audit jobs: converted items against their sources, and the dataset that reviews confirm."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions import text as tx
from sparkgrade.operators import confirm, issues, scoring
from sparkgrade.operators.keys import last_per_key
from sparkgrade.sources import readers
from sparkgrade.session import cut_lineage

Scorer = Callable[[], Callable[[str], str]]

# What an audit shows of an item, as far as the table has it.
AUDITED = [
    "id", "split", "chapter", "problem_number", "sub_id", "question_original", "question_standalone",
    "reference_answer", "reference_answer_sympy", "answer_kind", "extract_confidence",
]
PLACE = ["source_path", "chapter", "problem_number", "sub_id"]
REVIEWED = ["question", "reasoning", "answer_reference", "answer_sympy", "answer_compare"]


@dataclass
class ConversionAudit:
    """``rows``: split, id, status (assessed, missing_source, failed) and assessment, one row per
    item; ``issues``: split, id, stage, severity, code, message, details, any number per item."""

    rows: DataFrame
    issues: DataFrame

    def summary(self) -> DataFrame:
        """One row; an item with several issues counts once in ``rows_with_issues``."""
        per_row = issues.issues_per_row(self.issues)
        totals = per_row.agg(F.count("*").alias("rows"), F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"))
        totals = cut_lineage(totals, "issue-totals")
        scored = issues.mean_score(self.rows)
        return self.rows.agg(
            F.count("*").alias("total_rows"), F.count_if(F.col("status") == "missing_source").alias("missing_source_rows"),
        ).select(
            "total_rows", totals.select("rows").scalar().alias("rows_with_issues"),
            totals.select("issues").scalar().alias("total_issues"), "missing_source_rows",
            scored.select("scored_rows").scalar().alias("scored_rows"), scored.select("mean_score").scalar().alias("mean_score"),
        )

    def counts(self) -> DataFrame:
        return issues.issue_rollup(self.issues)

    def top_codes(self, n: int = 30) -> DataFrame:
        """The most frequent codes; of equally frequent ones, that of the least id first."""
        return issues.top_codes(self.issues, F.col("id"), n)


def audit_request(columns: list[str]) -> Column:
    """Request text: the item and its source as JSON, absent and NULL fields left out."""
    shown = [F.col(c) for c in AUDITED if c in columns]
    source = F.struct(F.trim("source.problem_latex").alias("problem"), F.trim("source.answer_latex").alias("answer"))
    item = F.to_json(F.struct(F.struct(*shown).alias("item"), source.alias("source")))
    return F.concat(F.lit("Compare the converted item with its source and list what is wrong, as JSON.\n"), item)


def conversion_audit(
    items: DataFrame, sources: DataFrame, auditor: Scorer, attempts: int = 4, threads: int = 1,
) -> ConversionAudit:
    """Have ``auditor`` compare every item with its source.

    ``items`` has ``split, id`` and the columns of ``resolve_sources``; ``sources`` has
    ``source_key`` and ``source``, a struct of ``problem_latex`` and ``answer_latex``. An item
    without a source, and one whose replies are no JSON object, has one issue that says so.
    """
    placed = readers.resolve_sources(items, sources)
    lost = placed.filter("source IS NULL")
    asked = placed.filter("source IS NOT NULL").select(
        "split", "id", scoring.score(audit_request(items.columns), auditor, attempts, threads, scoring.is_object).alias("scored"),
    )
    asked = cut_lineage(asked, "assessments")
    assessed = scoring.succeeded(asked).select("split", "id", tx.strip_code_fence("scored.response").alias("assessment"))
    failed = asked.filter("scored.status != 'success'")

    def rows(df: DataFrame, status: str, assessment: Column) -> DataFrame:
        return df.select("split", "id", F.lit(status).alias("status"), assessment.alias("assessment"))

    nothing = F.lit(None).cast("string")
    every = rows(assessed, "assessed", F.col("assessment")).unionByName(
        rows(lost, "missing_source", nothing)).unionByName(rows(failed, "failed", nothing))
    place = F.to_json(F.struct(*[F.col(c) for c in PLACE]), {"ignoreNullFields": "false"})
    found = issues.issues_from_assessment(assessed).unionByName(
        issues.make_issue(lost, "source", "error", "out_split_source_missing", "No source file for this item.", place)
    ).unionByName(
        issues.make_issue(failed, "llm_eval", "error", "llm_eval_failed", F.concat(F.lit("Audit failed: "), F.col("scored.error")))
    )
    return ConversionAudit(every, found)


@dataclass
class ConfirmedDataset:
    """``items``: the confirmed rows; ``resolved``: every candidate with its status;
    ``ignored``: expert entries of items that were not sampled."""

    items: DataFrame
    resolved: DataFrame
    ignored: DataFrame

    def manifest(self) -> DataFrame:
        ignored = self.ignored.groupBy(F.col("reason").alias("name")).agg(F.count("*").alias("n"))
        return confirm.manifest(self.items, self.resolved).unionByName(
            ignored.select(F.lit("ignored").alias("section"), "name", "n"))


def confirmed_dataset(
    base: DataFrame, export: DataFrame, expert: DataFrame, sampled: DataFrame, explicit: DataFrame, excluded: DataFrame,
    patches: DataFrame | None = None, patched: tuple[str, ...] = (),
) -> ConfirmedDataset:
    """Base items that a reviewer's code, a list of ids or an expert's silence confirms.

    ``base`` has ``id, split, chapter``, the columns of ``materialise_reviews`` and ``_pos``;
    ``export`` has ``id, comment, codes, _pos`` and the reviewed values; ``expert`` has ``split,
    id, annotator, comment, question, solution, answer, saved_at``; ``sampled`` has the (split,
    id) that experts were given, ``explicit`` and ``excluded`` ids. The last row of an id counts,
    of expert entries that of the last split; blank ids are left out.
    """
    base = last_per_key(base.filter(tx.blank_to_null("id").isNotNull()), ["id"], ["_pos"]).drop("_pos")
    export = last_per_key(export.filter(tx.blank_to_null("id").isNotNull()), ["id"], ["_pos"]).drop("_pos")
    given, ignored = confirm.sampled_entries(expert, sampled)
    silent = confirm.is_silent("comment", "question", "solution", "answer")
    entries = cut_lineage(given.withColumn("silent", silent), "expert-entries")
    candidates = confirm.bucket_candidates(export, entries, explicit.distinct(), excluded)
    resolved = cut_lineage(confirm.resolve_candidates(candidates, base, export, entries), "resolved")

    items = confirm.materialise_reviews(base.join(confirm.confirmed_items(resolved), "id"), export.select("id", *REVIEWED))
    if patches is not None:
        items = confirm.apply_patches(items, patches, patched)
    comments = last_per_key(entries, ["id"], ["split"]).select(
        "id", F.col("annotator").alias("expert_annotator"), F.col("comment").alias("expert_comment"),
        F.col("question").alias("expert_rewritten_question"), F.col("solution").alias("expert_rewritten_solution"),
        F.col("answer").alias("expert_rewritten_answer"), F.col("saved_at").alias("expert_saved_at"), F.lit(True).alias("_seen"),
    )
    by_expert = F.col("confirmation_status") == "confirmed_by_expert"
    items = items.join(comments, "id", "left").withColumns({
        c: F.when(by_expert, F.col(c)) for c in comments.columns if c.startswith("expert_")
    }).drop("_seen")
    chapter = F.coalesce(tx.blank_to_null("chapter"), F.lit("unknown"))
    split = F.coalesce(tx.blank_to_null("split"), F.concat(F.lit("chapter_"), chapter))
    return ConfirmedDataset(items.withColumn("split", split), resolved, ignored)
