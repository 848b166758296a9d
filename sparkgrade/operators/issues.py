"""Issues found by a conversion audit: parsing, rollups, mean score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions import text as tx
from sparkgrade.operators.summary import top_counts

# The parts of an assessment that list issues.
AUDIT_STAGES = ["conversion", "extraction"]
_BLOCK = "issues:array<struct<severity:string,code:string,message:string,details:string>>"
ASSESSMENT = ", ".join(
    [f"{stage} struct<{_BLOCK}>" for stage in AUDIT_STAGES] + ["overall struct<score:string>"]
)


def parse_assessment(raw: Column | str) -> Column:
    return F.from_json(F.col(raw) if isinstance(raw, str) else raw, ASSESSMENT)


def issues_from_assessment(rows: DataFrame, raw: Column | str = "assessment") -> DataFrame:
    """One row per issue of a JSON assessment; unusable JSON gives none."""
    empty = F.array().cast("array<struct<severity:string,code:string,message:string,details:string>>")

    def tagged(stage: str) -> Column:
        return F.transform(
            F.coalesce(F.col(f"_a.{stage}.issues"), empty),
            lambda i: F.struct(F.lit(stage).alias("stage"), i.alias("issue")),
        )

    listed = rows.withColumn("_a", parse_assessment(raw)).select(
        "split", "id", F.explode(F.concat(*map(tagged, AUDIT_STAGES))).alias("i")
    )
    default = F.concat(F.col("i.stage"), F.lit(" issue flagged by LLM"))
    return listed.filter("i.issue IS NOT NULL").select(
        "split",
        "id",
        F.col("i.stage").alias("stage"),
        tx.severity(F.coalesce(F.col("i.issue.severity"), F.lit("warn"))).alias("severity"),
        tx.issue_code(F.coalesce(F.col("i.issue.code"), F.lit("llm_issue"))).alias("code"),
        F.coalesce(tx.blank_to_null(F.col("i.issue.message")), default).alias("message"),
        F.col("i.issue.details").alias("details"),
    )


def make_issue(
    rows: DataFrame, stage: str, severity: str, code: str, message: Column | str, details: Column | None = None,
) -> DataFrame:
    """One issue per row of ``rows``, for what rules find, such as a missing source."""
    return rows.select(
        "split", "id", F.lit(stage).alias("stage"), F.lit(severity).alias("severity"),
        tx.issue_code(F.lit(code)).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"),
        (F.lit(None).cast("string") if details is None else details).alias("details"),
    )


def issue_rollup(issues: DataFrame, dimensions: Sequence[str] = ("severity", "code", "stage")) -> DataFrame:
    """Issue counts by severity, code and stage: counted once per combination, then rolled up."""
    combos = issues.groupBy(*dimensions).agg(F.count("*").alias("n"))
    rolled = combos.groupingSets([[d] for d in dimensions], *dimensions).agg(
        F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions]).alias("dimension"),
        F.sum("n").alias("n"),
    )
    return rolled.select("dimension", F.coalesce(*dimensions).alias("value"), "n")


def issues_per_row(issues: DataFrame) -> DataFrame:
    """Issue counts per item. The issues themselves stay rows: an item may have any number."""
    return issues.groupBy("split", "id").agg(
        F.count("*").alias("issues"), F.count_if(F.col("severity") == "error").alias("errors")
    )


def top_codes(issues: DataFrame, first_pos: Column, n: int = 30) -> DataFrame:
    return top_counts(issues, "code", n, first_pos)


def mean_score(rows: DataFrame, raw: Column | str = "assessment") -> DataFrame:
    score = parse_assessment(raw)["overall"]["score"].try_cast("double")
    return rows.agg(F.count(score).alias("scored_rows"), F.avg(score).alias("mean_score"))
