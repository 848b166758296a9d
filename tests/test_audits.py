"""The audit jobs on rows that are blank, lost or refused."""

from __future__ import annotations

import json

from sparkgrade.operators import confirm
from sparkgrade.plans import audits

PLACED = "split string, id string, source_path string, chapter string, problem_number string, sub_id string"
SOURCES = "source_key string, source struct<problem_latex: string, answer_latex: string>"


def auditor():
    """A scorer set-up that workers get by value: this module is not on their path."""
    def setup():
        def call(request: str) -> str:
            shown = json.loads(request.split("\n", 1)[1])
            if shown["item"]["id"] == "refused":
                raise RuntimeError("too long")
            issue = {"severity": "INFO", "code": "Odd one!", "message": shown["source"]["problem"], "details": {"at": 3}}
            return json.dumps({"conversion": {"issues": [issue, issue]}, "overall": {"score": 8}})

        return call

    return setup


def test_conversion_audit(spark):
    items = spark.createDataFrame([
        ("s", "good", None, "c", "1", " "), ("s", "refused", "/x/datasets/chapters/c/out_split/1/main.json", None, None, None),
        ("s", "lost", "", "c", "9", "i"),
    ], PLACED)
    sources = spark.createDataFrame([("c/out_split/1/main.json", (" text ", None))], SOURCES)
    audit = audits.conversion_audit(items, sources, auditor(), attempts=2)
    found = {(r.id, r.stage, r.severity, r.code, r.message) for r in audit.issues.collect()}
    assert found == {
        ("good", "conversion", "info", "odd_one", "text"),
        ("refused", "llm_eval", "error", "llm_eval_failed", "Audit failed: RuntimeError: too long"),
        ("lost", "source", "error", "out_split_source_missing", "No source file for this item."),
    }
    details = {r.id: r.details for r in audit.issues.collect()}
    assert json.loads(details["good"]) == {"at": 3}
    assert json.loads(details["lost"]) == {"source_path": "", "chapter": "c", "problem_number": "9", "sub_id": "i"}
    assert audit.summary().first().asDict() == {
        "total_rows": 3, "rows_with_issues": 3, "total_issues": 4, "missing_source_rows": 1, "scored_rows": 1, "mean_score": 8.0,
    }
    assert {r.id: r.status for r in audit.rows.collect()} == {"good": "assessed", "refused": "failed", "lost": "missing_source"}


def test_conversion_audit_of_nothing(spark):
    audit = audits.conversion_audit(spark.createDataFrame([], PLACED), spark.createDataFrame([], SOURCES), auditor())
    assert audit.issues.count() == 0
    assert audit.summary().first().asDict() == {
        "total_rows": 0, "rows_with_issues": 0, "total_issues": 0, "missing_source_rows": 0, "scored_rows": 0, "mean_score": None,
    }


def test_silence_and_samples(spark):
    entries = spark.createDataFrame(
        [("a", "1", None, " "), ("a", "2", "x", ""), ("b", "1", "", "\t")], "split string, id string, comment string, answer string")
    assert [r.s for r in entries.select(confirm.is_silent("comment", "answer").alias("s")).collect()] == [True, False, True]
    pairs = spark.createDataFrame([("a", "1"), ("a", "1"), ("c", "9")], "split string, id string")
    given, ignored = confirm.sampled_entries(entries, pairs)
    assert [(r.split, r.id) for r in given.collect()] == [("a", "1")]
    assert sorted((r.split, r.id) for r in ignored.collect()) == [("a", "2"), ("b", "1")]
