"""Answers: the request column, post-processing of responses, reconversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions import answers as an
from sparkgrade.functions import symbols as sy
from sparkgrade.functions import text as tx
from sparkgrade.functions.text import MISSING, as_column


def solve_request(
    question: Column | str, kind: Column | str, allowed: Column | str, json_keys: Column | str
) -> Column:
    """Question, expected answer type, and the rules its type brings along."""
    kind = F.coalesce(F.lower(tx.blank_to_null(kind)), F.lit("sympy"))
    names = F.filter(F.transform(as_column(allowed), lambda s: tx.strip(s)), lambda s: s != "")
    keys = F.filter(F.transform(as_column(json_keys), lambda s: tx.strip(s)), lambda s: s != "")
    symbols = F.when(
        (kind == "sympy") & (F.size(names) > 0),
        F.concat(F.lit("\nUse no symbols but: "), F.array_join(names, ", ")),
    )
    fields = F.when(kind == "json", F.concat(
        F.lit("\nAnswer with one strict JSON object"),
        F.when(F.size(keys) > 0, F.concat(F.lit(" with the keys: "), F.array_join(keys, ", "))).otherwise(""),
    ))
    short = F.when(kind == "text", F.lit("\nAnswer with a short text"))
    return F.concat(
        F.lit("Question:\n"), F.coalesce(as_column(question), F.lit("")),
        F.lit("\n\nExpected answer type: "), kind,
        F.lit("\nPut the final answer in exactly one \\boxed{...}."),
        F.coalesce(symbols, F.lit("")), F.coalesce(fields, F.lit("")), F.coalesce(short, F.lit("")),
    )


def payload_request(heading: str, **fields: Column) -> Column:
    """A heading and the fields as one JSON object."""
    return F.concat(F.lit(heading + "\n"), F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])))


def needs_conversion(boxed: Column, kind: Column, mode: Column) -> Column:
    symbolic = ~((kind == "bool") | (mode == "exact") | (mode == "json"))
    return symbolic & (sy.normalize_expression(boxed) != MISSING)


def conversion_request(boxed: Column, kind: Column, mode: Column) -> Column:
    """Request for the converter, NULL for rows that need none."""
    return F.when(
        needs_conversion(boxed, kind, mode),
        F.concat(F.lit("Convert this answer to an expression:\n"), sy.normalize_expression(boxed)),
    )


def process_responses(rows: DataFrame, converted: Column | str | None = None) -> DataFrame:
    """Boxed, boolean, JSON and symbolic answers out of ``model_response``.

    Needs ``answer_kind, comparison_mode, symbol_contract_allowed_symbols``. ``converted``
    is the converter's reply; where it is NULL or empty the normalised box stands.
    """
    kind, mode = F.col("answer_kind"), F.col("comparison_mode")
    rows = rows.withColumn("answer_boxed", an.boxed_answer("model_response"))
    exact = (kind == "bool") | (mode == "exact")
    is_json = ~exact & (mode == "json")
    symbolic = ~exact & ~is_json
    plain = sy.normalize_expression("answer_boxed")
    if converted is not None:
        plain = F.when(plain == MISSING, plain).otherwise(
            F.coalesce(an.converted_expression(as_column(converted), plain), plain)
        )
    rows = rows.withColumns({
        "answer_json": F.when(is_json, an.json_answer("answer_boxed")),
        "answer_sympy": F.when(symbolic, plain).otherwise(MISSING),
    })
    final = (
        F.when(exact, F.coalesce(tx.answer_bool("answer_boxed"), F.col("answer_boxed")))
        .when(is_json, an.json_or_text("answer_boxed", F.col("answer_json")))
        .when(F.col("answer_sympy") != MISSING, F.col("answer_sympy"))
        .otherwise(F.col("answer_boxed"))
    )
    rows = rows.withColumn("final_answer_for_compare", final)
    allowed = F.coalesce("symbol_contract_allowed_symbols", F.array().cast("array<string>"))
    # In symbolic mode the final answer is in normal form already.
    off = F.when(mode == "sympy", sy.off_list(sy.tokens_of_normal(F.col("final_answer_for_compare")), allowed)).otherwise(
        F.array().cast("array<string>")
    )
    return rows.withColumn("mismatch_symbols", off).withColumn(
        "symbol_mismatch", F.size("mismatch_symbols") > 0
    )


def should_reconvert(only_bad: bool, detail: Column | str = "detail") -> Column:
    """Symbolic and JSON rows; with ``only_bad`` just those without a usable expression."""
    exempt = (F.lower(tx.strip("answer_kind")) == "bool") | (F.lower(tx.strip("comparison_mode")) == "exact")
    wanted = ~F.coalesce(exempt, F.lit(False))
    if not only_bad:
        return wanted
    unusable = sy.normalize_expression("answer_sympy") == MISSING
    failed = F.coalesce(F.startswith(as_column(detail), F.lit("sympy_parse_failed")), F.lit(False))
    return wanted & (unusable | failed)


def reconvert(
    answers: DataFrame, evals: DataFrame | None = None, only_bad: bool = False, keys: Sequence[str] = ("split", "id")
) -> DataFrame:
    """Re-read stored responses with today's rules; adds ``targeted`` and ``changed``."""
    rows = answers
    if evals is not None:
        rows = rows.join(evals.select(*keys, F.col("detail").alias("_detail")), list(keys), "left")
    else:
        rows = rows.withColumn("_detail", F.lit(None).cast("string"))
    rows = rows.withColumn("targeted", should_reconvert(only_bad, "_detail"))
    outputs = ["answer_boxed", "answer_json", "answer_sympy", "final_answer_for_compare", "mismatch_symbols", "symbol_mismatch"]
    old = rows.select("*", *[F.col(c).alias(f"_old_{c}") for c in outputs])
    new = process_responses(old)
    differs = ~F.col("answer_sympy").eqNullSafe(F.col("_old_answer_sympy")) | ~F.col(
        "final_answer_for_compare"
    ).eqNullSafe(F.col("_old_final_answer_for_compare"))
    new = new.withColumn("changed", F.col("targeted") & differs)
    kept = {c: F.when(F.col("targeted"), F.col(c)).otherwise(F.col(f"_old_{c}")) for c in outputs}
    return new.withColumns(kept).drop("_detail", *[f"_old_{c}" for c in outputs])


def reconvert_counts(rows: DataFrame) -> DataFrame:
    """Rows, targeted and changed per split and overall."""
    parts = rows.groupBy("split").agg(
        F.count("*").alias("rows_total"), F.count_if("targeted").alias("targeted"), F.count_if("changed").alias("changed")
    )
    return parts.rollup("split").agg(
        F.when(F.grouping("split") == 1, "overall").otherwise("split").alias("level"),
        F.sum("rows_total").alias("rows_total"), F.sum("targeted").alias("targeted"), F.sum("changed").alias("changed"),
    )
