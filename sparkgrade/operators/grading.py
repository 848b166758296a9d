"""Rule grading: joining answers to items and judging them by mode.

The whole grade is one projection over the joined rows. Answers with several parts are
arrays inside the row, so no mode needs an explode and a group-by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade import schemas
from sparkgrade.functions import answers as an
from sparkgrade.functions import labels as lb
from sparkgrade.functions import symbols as sy
from sparkgrade.functions import text as tx
from sparkgrade.functions.text import MISSING, as_column
from sparkgrade.operators import identity, overlay

ITEM = "struct<key:string,reference:string,prediction:string,is_correct:boolean,detail:string>"
PARTS = "array<struct<key:string,reference:string,prediction:string,rule:string>>"
SUFFIX = "_with_symbol_mismatch"
ANSWER_FIELDS = ["answer_sympy", "final_answer_for_compare", "answer_boxed", "answer_json"]
RESULT_COLUMNS = [
    "assignment_group", "question_type", "answer_kind", "comparison_mode", "prediction", "reference",
    "is_correct", "detail", "symbol_contract_allowed_symbols", "symbol_mismatch", "mismatch_symbols",
    "reference_symbol_issue", "reference_mismatch_symbols", "json_items", "json_missing_keys",
    "json_extra_keys", "points", "points_earned",
]


def answer_kind(kind: Column | str) -> Column:
    """Lower-case kind; blank or unknown kinds are symbolic."""
    low = F.lower(tx.strip(kind))
    return F.when(low.isin("sympy", "bool", "text", "json"), low).otherwise("sympy")


def comparison_mode(mode: Column | str, kind: Column | str) -> Column:
    """Declared mode, else the one its answer kind implies."""
    low, of = F.lower(tx.strip(mode)), F.lower(tx.strip(kind))
    return (
        F.when(low.isin("exact", "sympy", "json"), low)
        .when(of.isin("bool", "text"), "exact")
        .when(of == "json", "json")
        .otherwise("sympy")
    )


def exact_value(text: Column | str) -> Column:
    """A boolean answer in its normal form, else collapsed text."""
    return F.coalesce(tx.answer_bool(text), tx.collapse_spaces(text), F.lit(""))


def exact_grade(prediction: Column | str, gold: Column | str) -> Column:
    return exact_value(prediction) == exact_value(gold)


def grade_join(
    dataset: DataFrame, answers: DataFrame, keys: Sequence[str] = ("split", "id"), include_missing: bool = True
) -> DataFrame:
    """Items with their answers (columns ``pred_*``); ``has_answer`` tells the missing ones.

    Without ``include_missing`` unanswered items are left out instead of counting as wrong.
    """
    fields = [F.col(f).alias(f"pred_{f}") for f in ANSWER_FIELDS]
    right = schemas.complete(answers, schemas.GENERATION).select(*keys, *fields, F.lit(True).alias("has_answer"))
    joined = dataset.join(right, list(keys), "left" if include_missing else "inner")
    return joined.withColumn("has_answer", F.coalesce("has_answer", F.lit(False)))


def _nonempty(answer: Column) -> Column:
    return F.when(F.size(answer) > 0, answer)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _json_parts(gold: Column, answer: Column, modes: Column) -> Column:
    """One struct per gold key: both values and the rule that settles them.

    A gold value that reads as a boolean is compared as one before its declared mode.
    """
    def part(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        given = F.try_element_at(answer, key)
        declared = F.lower(tx.strip(F.try_element_at(modes, key)))
        rule = (
            F.when(given.isNull(), "missing")
            .when(tx.answer_bool(value).isNotNull(), "bool")
            .when(declared.isin("sympy", "text"), declared)
            .when(an.looks_like_math(value), "sympy")
            .otherwise("text")
        )
        return F.struct(
            key.alias("key"), value.alias("reference"), given.alias("prediction"), rule.alias("rule")
        )

    return F.transform(F.array_sort(F.map_entries(gold)), part)


def _with_expressions(part: Column) -> Column:
    """The part with both values in normal form, NULL unless they are expressions."""
    symbolic = part["rule"] == "sympy"
    return F.struct(
        *[part[f].alias(f) for f in ("key", "reference", "prediction", "rule")],
        F.when(symbolic, sy.normalize_expression(part["reference"])).alias("gold"),
        F.when(symbolic, sy.normalize_expression(part["prediction"])).alias("given"),
    )


def _with_symbols(part: Column, allowed: Column) -> Column:
    """The part with its reference's symbols and the symbols that are off the list.

    Without a list the reference's own symbols are the list.
    """
    def audit(own: Column) -> Column:
        listed = F.when(F.size(allowed) > 0, allowed).otherwise(own)
        return F.struct(
            *[part[f].alias(f) for f in ("key", "reference", "prediction", "rule", "gold", "given")],
            own.alias("own"),
            F.coalesce(sy.off_list(sy.tokens_of_normal(part["given"]), listed), _empty("string")).alias("off_prediction"),
            F.coalesce(sy.off_list(own, listed), _empty("string")).alias("off_reference"),
        )

    return tx.let(F.coalesce(sy.tokens_of_normal(part["gold"]), _empty("string")), audit)


def _settle(item: Column, verdict: Column) -> Column:
    """Verdict and detail of one part."""
    rule, gold, given = item["rule"], item["reference"], item["prediction"]
    exact = F.when(rule == "bool", tx.answer_bool(given).eqNullSafe(tx.answer_bool(gold))).otherwise(
        tx.collapse_spaces(given) == tx.collapse_spaces(gold)
    )
    off = (F.size(item["off_prediction"]) > 0) | (F.size(item["off_reference"]) > 0)
    detail = (
        F.when(rule == "missing", "missing_key")
        .when(rule == "sympy", F.concat(F.lit("sympy_"), verdict, F.when(off, SUFFIX).otherwise("")))
        .when(exact, "exact_equal")
        .otherwise("exact_not_equal")
    )
    correct = F.when(rule == "missing", False).when(rule == "sympy", verdict == identity.EQUAL).otherwise(exact)
    return F.struct(
        item["key"].alias("key"),
        gold.alias("reference"),
        F.coalesce(given, F.lit(MISSING)).alias("prediction"),
        correct.alias("is_correct"),
        detail.alias("detail"),
    )


def grade(joined: DataFrame) -> DataFrame:
    """Grade the rows of :func:`grade_join`; adds ``RESULT_COLUMNS``, keeps the key columns."""
    keys = [c for c in ("model", "split", "id") if c in joined.columns]
    rows = schemas.complete(joined, schemas.DATASET, schemas.OVERLAY)

    rows = rows.withColumns({
        "_mode": comparison_mode("comparison_mode", "answer_kind"),
        "_kind": F.coalesce(F.lower(tx.blank_to_null("answer_kind")), F.lit("sympy")),
        "_reference": overlay.effective_reference(),
        "_symbolic": overlay.effective_symbolic(),
        "_listed": sy.allowed_symbols("symbol_contract_allowed_symbols"),
        "_given": F.coalesce(tx.first_text("pred_final_answer_for_compare", "pred_answer_boxed"), F.lit("")),
    })
    rows = rows.withColumns({
        "_gold_text": tx.clean_text(tx.first_text("_symbolic", "_reference")),
        "_given_text": tx.clean_text(tx.first_text("pred_answer_sympy", "_given")),
        "_gold_json": F.when(
            F.col("_mode") == "json", F.coalesce(_nonempty(F.col("reference_answer_json")), an.json_answer("_reference"))
        ),
        "_given_json": F.when(
            F.col("_mode") == "json", F.coalesce(_nonempty(F.col("pred_answer_json")), an.json_answer("_given"))
        ),
        "_allowed": F.when(F.size("_listed") > 0, F.col("_listed"))
        .otherwise(sy.parse_contract("symbol_contract")["allowed_symbols"]),
    })

    both_json = F.col("_gold_json").isNotNull() & F.col("_given_json").isNotNull()
    one_expression = F.array(F.struct(
        F.lit("").alias("key"), F.col("_gold_text").alias("reference"),
        F.col("_given_text").alias("prediction"), F.lit("sympy").alias("rule"),
    ))
    parts = (
        F.when(F.col("has_answer") & (F.col("_mode") == "sympy"), one_expression.cast(PARTS))
        .when(F.col("has_answer") & both_json, _json_parts(
            F.col("_gold_json"), F.col("_given_json"), F.col("reference_answer_json_modes")
        ).cast(PARTS))
        .otherwise(F.array().cast(PARTS))
    )
    rows = rows.withColumn("_parts", parts)
    rows = rows.withColumn("_parts", F.transform("_parts", _with_expressions))
    rows = rows.withColumn("_items", F.transform("_parts", lambda p: _with_symbols(p, F.col("_allowed"))))
    # Rows without symbolic parts send NULL to Python and get NULL back.
    needed = F.exists("_parts", lambda p: p["gold"].isNotNull())
    rows = rows.withColumn("_verdicts", identity.expression_verdicts(
        F.when(needed, F.col("_parts.given")), F.when(needed, F.col("_parts.gold"))
    ))
    verdicts = F.coalesce("_verdicts", F.transform("_items", lambda _: F.lit(None).cast("string")))
    rows = rows.withColumn("_settled", F.zip_with("_items", verdicts, _settle))

    mode = F.col("_mode")
    off_prediction = F.array_distinct(F.flatten(F.transform("_items", lambda i: i["off_prediction"])))
    off_reference = F.array_distinct(F.flatten(F.transform("_items", lambda i: i["off_reference"])))
    rows = rows.withColumns({
        "_allowed": F.when((mode == "sympy") & (F.size("_allowed") == 0) & F.col("has_answer"), F.col("_items")[0]["own"])
        .otherwise(F.col("_allowed")),
        "_off_prediction": off_prediction,
        "_off_reference": off_reference,
        "_missing_keys": F.when(both_json, an.json_missing_keys(F.col("_gold_json"), F.col("_given_json"))),
        "_extra_keys": F.when(both_json, an.json_extra_keys(F.col("_gold_json"), F.col("_given_json"))),
        "_exact": exact_grade("_given", "_reference"),
    })
    no_missing, no_extra = F.size("_missing_keys") == 0, F.size("_extra_keys") == 0
    json_ok = both_json & no_missing & no_extra & F.forall("_settled", lambda s: s["is_correct"])
    json_detail = (
        F.when(F.col("_gold_json").isNull(), "json_reference_invalid")
        .when(F.col("_given_json").isNull(), "json_prediction_invalid")
        .when(json_ok, "json_equal")
        .when(~no_missing, "json_missing_keys")
        .when(~no_extra, "json_extra_keys")
        .otherwise("json_not_equal")
    )
    off = (F.size("_off_prediction") > 0) | (F.size("_off_reference") > 0)
    correct = (
        F.when(~F.col("has_answer"), False)
        .when(mode == "json", json_ok)
        .when(mode == "exact", F.col("_exact"))
        .otherwise(F.col("_settled")[0]["is_correct"])
    )
    detail = (
        F.when(~F.col("has_answer"), "missing_prediction")
        .when(mode == "json", F.concat(json_detail, F.when(off, SUFFIX).otherwise("")))
        .when(mode == "exact", F.when(F.col("_exact"), "exact_equal").otherwise("exact_not_equal"))
        .otherwise(F.col("_settled")[0]["detail"])
    )
    prediction = (
        F.when(~F.col("has_answer"), MISSING)
        .when(mode == "json", an.json_or_text("_given", F.col("_given_json")))
        .when(mode == "exact", exact_value("_given"))
        .otherwise(F.col("_given_text"))
    )
    reference = (
        F.when(~F.col("has_answer"), tx.or_missing("_reference"))
        .when(mode == "json", an.json_or_text("_reference", F.col("_gold_json")))
        .when(mode == "exact", exact_value("_reference"))
        .otherwise(F.col("_gold_text"))
    )
    weight = tx.points("points")
    return rows.select(
        *keys,
        lb.assignment_group(
            F.col("split"), F.col("chapter"), F.col("original_id"), F.col("problem_number"), F.col("id")
        ).alias("assignment_group"),
        F.coalesce(F.lower(tx.blank_to_null("question_type")), F.lit("value")).alias("question_type"),
        F.col("_kind").alias("answer_kind"),
        mode.alias("comparison_mode"),
        prediction.alias("prediction"),
        reference.alias("reference"),
        correct.alias("is_correct"),
        detail.alias("detail"),
        F.col("_allowed").alias("symbol_contract_allowed_symbols"),
        (F.size("_off_prediction") > 0).alias("symbol_mismatch"),
        F.col("_off_prediction").alias("mismatch_symbols"),
        (F.size("_off_reference") > 0).alias("reference_symbol_issue"),
        F.col("_off_reference").alias("reference_mismatch_symbols"),
        F.when(mode == "json", F.col("_settled")).otherwise(_empty(ITEM)).alias("json_items"),
        F.coalesce("_missing_keys", _empty("string")).alias("json_missing_keys"),
        F.coalesce("_extra_keys", _empty("string")).alias("json_extra_keys"),
        weight.alias("points"),
        F.when(correct, weight).otherwise(0.0).alias("points_earned"),
    )


def parse_audit(rows: DataFrame, fields: Sequence[str], id_column: str = "id") -> DataFrame:
    """One row per symbolic target field: ``id, field, value, ok, error``.

    Blank and ``N/A`` targets fail as ``empty_or_na``.
    """
    symbolic = rows.filter(F.lower(tx.strip("comparison_mode")) == "sympy")
    targets = symbolic.select(
        F.col(id_column).alias("id"),
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("field"), F.coalesce(tx.collapse_spaces(f), F.lit("")).alias("value")) for f in fields
        ])).alias("t"),
    ).select("id", "t.*")
    empty = F.col("value").isin("", MISSING)
    parsed = identity.expression_parses(F.when(~empty, sy.normalize_expression("value")))
    return targets.withColumn("_parsed", parsed).select(
        "id", "field", "value",
        F.coalesce("_parsed", F.lit(False)).alias("ok"),
        F.when(empty, "empty_or_na").when(~F.col("_parsed"), "parse_failed").alias("error"),
    )


def parse_audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count("*").alias("parse_targets_total"),
        F.count_if("ok").alias("parse_targets_ok"),
        F.count_if(~F.col("ok")).alias("parse_targets_failed"),
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_sympy_targets_parseable"),
    )


def error_export(evals: DataFrame, dataset: DataFrame, answers: DataFrame, keys: Sequence[str] = ("split", "id")) -> DataFrame:
    """Wrong evaluations with question, answers and reasoning, first non-blank over three tables."""
    ds = schemas.complete(dataset, schemas.DATASET)
    gen = schemas.complete(answers, schemas.GENERATION)
    ds = ds.select(*keys, F.struct(
        "question_type", "answer_kind", "question_final", "reference_answer", "reference_reasoning"
    ).alias("d"))
    gen = gen.select(*keys, F.struct(
        "question_type", "answer_kind", "question_final", "reference_answer", "model_response",
        "final_answer_for_compare", "answer_boxed",
    ).alias("g"))
    wrong = schemas.complete(evals, schemas.RULE_EVAL).filter(
        ~F.coalesce("is_correct", F.lit(False)) & tx.blank_to_null(F.col("id").cast("string")).isNotNull()
    )
    wrong = wrong.select(*keys, F.struct(
        "question_type", "answer_kind", "reference", "prediction", "detail"
    ).alias("e"))
    rows = wrong.join(ds, list(keys), "left").join(gen, list(keys), "left")

    def first(*columns: str) -> Column:
        return F.coalesce(tx.first_text(*columns), F.lit(""))

    return rows.select(
        *keys,
        first("d.question_type", "g.question_type", "e.question_type").alias("question_type"),
        first("d.answer_kind", "g.answer_kind", "e.answer_kind").alias("answer_kind"),
        first("g.question_final", "d.question_final").alias("question"),
        first("d.reference_answer", "g.reference_answer", "e.reference").alias("reference_answer"),
        first("e.prediction", "g.final_answer_for_compare", "g.answer_boxed").alias("predict_answer"),
        first("d.reference_reasoning").alias("reference_reasoning"),
        first("g.model_response").alias("model_reasoning"),
        first("e.detail").alias("rule_detail"),
        first("e.prediction").alias("rule_prediction"),
        first("e.reference").alias("rule_reference"),
        F.lit("").alias("reason"),
    )


def earned(points: Column | str, is_correct: Column | str) -> Column:
    return F.when(as_column(is_correct), as_column(points)).otherwise(0.0)
