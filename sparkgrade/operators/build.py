"""Dataset building: what each stage asks and how its reply becomes rows.

A stage is a request column, a scorer call (see :mod:`sparkgrade.operators.scoring`) and
a projection of the reply. Here are the requests and the projections; the chain that
calls the scorer between them is :mod:`sparkgrade.plans.build`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions import answers as an
from sparkgrade.functions import labels as lb
from sparkgrade.functions import symbols as sy
from sparkgrade.functions import text as tx
from sparkgrade.functions.text import MISSING
from sparkgrade.operators.generation import payload_request
from sparkgrade.operators.scoring import reply_json

REFERENCE_REPLY = (
    "final_reference_answer string, reference_is_correct string, reference_generated_by_llm string, "
    "confidence string, analysis string"
)
SPLIT_REPLY = (
    "pairs array<struct<sub_index:string,question:string,answer:string,notes:string>>, "
    "question_count string, split_generated_by_llm string, analysis string"
)
CONVERT_REPLY = (
    "question_type string, comparison_mode string, converted_question string, reference_reasoning string, "
    "reference_answer string, comparable_final_answer string, reference_answer_sympy string, symbol_contract string"
)
SYNC_REPLY = "rewritten_question string, changed string, notes string"


def _unless_missing(expression: Column) -> Column:
    return F.get(F.array_remove(F.array(expression), F.lit(MISSING)), F.lit(0))


def problem_rows(files: DataFrame, parents: DataFrame) -> DataFrame:
    """Source problems with their parent problem and ids.

    ``files``: ``chapter, folder, stem, path`` and the problem fields; ``parents``:
    ``chapter, file, path, problem_latex, answer_latex``. The parent is the named source
    file, else ``<problem number>.json``, the first with any text.
    """
    number = tx.first_text("original_number", "number", "folder")
    rows = files.filter(tx.blank_to_null("problem_latex").isNotNull()).withColumns({
        "problem_number": number,
        "sub_id": lb.sub_id("subquestion_path", "stem"),
        "_named": tx.strip("source_file"),
    })
    rows = rows.withColumn("_own", F.concat("problem_number", F.lit(".json")))
    texts = parents.filter(tx.first_text("problem_latex", "answer_latex").isNotNull())

    def parent(column: str) -> DataFrame:
        return texts.select(
            "chapter", F.col("file").alias(column),
            F.struct("problem_latex", "answer_latex", "path").alias(f"{column}_parent"),
        )

    rows = rows.join(parent("_named"), ["chapter", "_named"], "left").join(
        parent("_own"), ["chapter", "_own"], "left"
    )
    found = F.coalesce("_named_parent", "_own_parent")
    return rows.select(
        lb.base_id("problem_number", "sub_id").alias("id"),
        "chapter",
        lb.split_name("chapter").alias("split"),
        "problem_number",
        "sub_id",
        F.col("path").alias("source_path"),
        F.coalesce(found["path"], F.lit("")).alias("source_problem_path"),
        tx.strip("problem_latex").alias("question_original"),
        F.coalesce(found["problem_latex"], F.lit("")).alias("source_problem_latex"),
        F.coalesce(tx.strip("answer_latex"), F.lit("")).alias("source_answer_latex"),
        F.coalesce(found["answer_latex"], F.lit("")).alias("reference_answer_latex_from_by_problem"),
        tx.clean_text(tx.first_text("answer_latex", found["answer_latex"])).alias("reference_answer_original"),
    )


def reference_request() -> Column:
    return payload_request(
        "Check the reference answer:",
        question=F.col("question_original"), reference=F.col("reference_answer_original"),
    )


def reference_rows(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Stage 1: the checked reference answer; without a usable reply the original stands."""
    parsed = reply_json(reply, REFERENCE_REPLY)
    original = F.col("reference_answer_original")
    corrected = tx.clean_text(parsed["final_reference_answer"], original)
    correct = F.coalesce(tx.loose_bool(parsed["reference_is_correct"]), corrected == original)
    made = F.coalesce(
        tx.loose_bool(parsed["reference_generated_by_llm"]), ~correct | (corrected != original)
    )
    return rows.withColumns({
        "reference_answer_corrected": corrected,
        "reference_is_correct": correct,
        "reference_answer_generated_by_llm": made,
        "confidence": F.coalesce(tx.confidence(parsed["confidence"]), F.lit("low")),
        "analysis": tx.clean_text(parsed["analysis"], ""),
        "llm_json": F.coalesce(reply, F.lit("{}")),
    }).drop(reply)


def split_request() -> Column:
    return payload_request(
        "Split the question into single targets:",
        question=F.col("question_original"), reference=F.col("reference_answer_corrected"),
    )


def split_rows(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Stage 2: the parts of a question, each with its parent's text kept.

    Parts without a question are dropped, blank answers take the whole answer; without
    any part the question is its own single part.
    """
    parsed = reply_json(reply, SPLIT_REPLY)
    question, answer = F.col("question_original"), F.col("reference_answer_corrected")

    def part(pair: Column, at: Column) -> Column:
        number = tx.int_in_text(pair["sub_index"], (at + 1).cast("bigint"))
        return F.struct(
            F.when(number == 0, at + 1).otherwise(number).cast("int").alias("sub_index"),
            F.coalesce(tx.strip(pair["question"]), F.lit("")).alias("question"),
            tx.clean_text(pair["answer"], answer).alias("answer"),
            tx.clean_text(pair["notes"], "").alias("notes"),
        )

    named = F.filter(F.transform(parsed["pairs"], part), lambda p: p["question"] != "")
    whole = F.array(F.struct(
        F.lit(1).alias("sub_index"), question.alias("question"), answer.alias("answer"), F.lit("fallback").alias("notes")
    ))
    rows = rows.withColumn("_pairs", F.when(F.size(named) > 0, named).otherwise(whole))
    one = (tx.int_in_text(parsed["question_count"], F.size("_pairs").cast("bigint")) <= 1) & (F.size("_pairs") == 1)

    def settle(pair: Column) -> Column:
        kept = tx.keep_stem(question, pair["question"], pair["sub_index"])
        return F.struct(
            pair["sub_index"].alias("sub_index"),
            F.when(one, question).when(F.size("_pairs") > 1, kept).otherwise(pair["question"]).alias("question"),
            F.when(one, answer).otherwise(pair["answer"]).alias("answer"),
            pair["notes"].alias("notes"),
        )

    return rows.withColumns({
        "pairs": F.transform("_pairs", settle),
        "question_count": F.size("_pairs"),
        "split_generated_by_llm": F.coalesce(
            tx.loose_bool(parsed["split_generated_by_llm"]), F.size("_pairs") > 1
        ),
        "split_analysis": tx.clean_text(parsed["analysis"], ""),
        "stage2_json": F.coalesce(reply, F.lit("{}")),
    }).drop("_pairs", reply)


def explode_pairs(rows: DataFrame, pairs: str = "pairs") -> DataFrame:
    """One row per part; ``#n`` is added to the id only when there are several parts."""
    exploded = rows.select("*", F.size(pairs).alias("pair_count"), F.posexplode(pairs).alias("_at", "_pair"))
    number = F.col("_at") + 1
    several = F.concat(F.col("id"), F.lit("#"), number.cast("string"))
    return exploded.withColumns({
        "original_id": F.col("id"),
        "pair_index": number,
        "pair_question": tx.first_text(F.col("_pair.question"), "question_original"),
        "pair_answer": tx.clean_text(F.col("_pair.answer"), F.col("reference_answer_corrected")),
        "id": F.when(F.col("pair_count") > 1, several).otherwise(F.col("id")),
    }).drop("_at", "_pair", pairs)


def convert_request(hint: Column | None = None) -> Column:
    fields = {"question": F.col("pair_question"), "reference": F.col("pair_answer")}
    if hint is not None:
        fields["repair"] = hint
    return payload_request("Convert to an evaluation item:", **fields)


def convert_rows(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Stage 3: type, mode, reference answer and symbol contract of each item."""
    parsed = reply_json(reply, CONVERT_REPLY)
    judge = F.lower(tx.strip(parsed["question_type"])) == "judge"
    judge = F.coalesce(judge, F.lit(False))
    answer = tx.clean_text(parsed["reference_answer"], F.col("pair_answer"))
    comparable = tx.clean_text(parsed["comparable_final_answer"], answer)
    verdict = F.coalesce(tx.answer_bool(comparable), tx.answer_bool(answer))

    candidates = F.transform(
        F.array(parsed["reference_answer_sympy"], comparable, answer), lambda e: sy.normalize_expression(e)
    )
    symbolic = F.coalesce(F.get(F.array_remove(candidates, F.lit(MISSING)), F.lit(0)), F.lit(MISSING))
    rows = rows.withColumns({
        "question_type": F.when(judge, "judge").otherwise("value"),
        "answer_kind": F.when(judge, "bool").otherwise("sympy"),
        "comparison_mode": F.when(judge, "exact").otherwise("sympy"),
        "reference_reasoning": F.coalesce(tx.strip(parsed["reference_reasoning"]), F.lit("")),
        "converted_answer": F.when(judge & verdict.isNull(), MISSING).otherwise(answer),
        "reference_answer_sympy": F.when(judge, MISSING).otherwise(symbolic),
        "comparable_final_answer": F.when(judge, F.coalesce(verdict, F.lit(MISSING))).otherwise(symbolic),
        "_contract": sy.parse_contract(parsed["symbol_contract"]),
        "_question": tx.first_text(parsed["converted_question"], "pair_question"),
    })
    listed = F.col("_contract.allowed_symbols")
    rows = rows.withColumn("allowed_symbols", F.when(F.col("question_type") == "judge", F.array().cast("array<string>"))
        .when(F.size(listed) > 0, listed).otherwise(sy.tokens_of_normal(F.col("reference_answer_sympy"))))
    rows = rows.withColumns({
        "symbol_definitions": F.col("_contract.symbol_definitions"),
        "symbol_contract_mismatch_symbols": sy.off_list(
            sy.tokens_of_normal(F.col("reference_answer_sympy")), F.col("allowed_symbols")
        ),
        "converted_question": F.when(F.col("question_type") == "judge", F.col("_question")).otherwise(
            sy.ensure_symbol_section("_question", "allowed_symbols", F.col("_contract.symbol_definitions"))
        ),
    })
    return rows.withColumns({
        "symbol_contract_validation_passed": F.size("symbol_contract_mismatch_symbols") == 0,
        "stage3_json": F.coalesce(reply, F.lit("{}")),
    }).drop("_contract", "_question", reply)


def repair_hint() -> Column:
    """What a second conversion must fix, NULL for rows that passed."""
    return F.when(
        (F.col("question_type") == "value") & ~F.col("symbol_contract_validation_passed"),
        F.concat(
            F.lit("the expression uses symbols that are not allowed: "),
            F.array_join("symbol_contract_mismatch_symbols", ", "),
        ),
    )


def sync_request() -> Column:
    """Ask for a rewrite in terms of the allowed symbols; NULL where nothing is to align."""
    section = sy.replace_symbol_section("converted_question", "allowed_symbols", "symbol_definitions")
    used = sy.tokens_of_normal(F.col("reference_answer_sympy"))
    payload = payload_request(
        "Align the symbols of the question:",
        converted_question=section,
        reference_answer_sympy=F.col("reference_answer_sympy"),
        used_symbols=F.when(F.size(used) > 0, used).otherwise(F.col("allowed_symbols")),
        allowed_symbols=F.col("allowed_symbols"),
    )
    wanted = (F.col("question_type") == "value") & (F.size("allowed_symbols") > 0) & (tx.strip("converted_question") != "")
    return F.when(wanted, payload)


def sync_rows(rows: DataFrame, reply: str = "reply", status: str = "reply_status") -> DataFrame:
    """Take over aligned questions, with one canonical symbol section.

    A rewrite shorter than 50 characters or 35 % of the question is refused, and a failed
    call leaves the question with its canonical section.
    """
    parsed = reply_json(reply, SYNC_REPLY)
    question = tx.strip("converted_question")

    def canonical(text: Column) -> Column:
        return sy.replace_symbol_section(text, "allowed_symbols", "symbol_definitions")

    own = canonical(question)
    rewritten = canonical(F.coalesce(tx.blank_to_null(parsed["rewritten_question"]), own))
    skipped = F.col(status) == "skipped"
    failed = (F.col(status) == "error") | parsed.isNull()
    floor = F.greatest(F.lit(50), F.floor(F.length(question) * 0.35).cast("int"))
    short = F.length(rewritten) < floor
    rows = rows.withColumns({
        "_before": question,
        "symbol_text_sync_status": F.when(skipped, "skipped").when(failed, "error").when(short, "fallback").otherwise("ok"),
        "symbol_text_sync_reason": F.when(skipped, "")
        .when(failed, "call failed")
        .when(short, "rewritten_question_too_short")
        .otherwise(F.coalesce(tx.strip(parsed["notes"]), F.lit(""))),
        "_after": F.when(skipped, question).when(failed | short, own).otherwise(rewritten),
        "_changed": tx.loose_bool(parsed["changed"]),
    })
    return rows.withColumns({
        "converted_question_before_symbol_sync": F.col("_before"),
        "converted_question": F.col("_after"),
        "symbol_text_sync_applied": F.col("_after") != F.col("_before"),
        "symbol_text_sync_changed_by_llm": (F.col("symbol_text_sync_status") == "ok")
        & F.coalesce("_changed", F.col("_after") != F.col("_before")),
    }).drop("_before", "_after", "_changed", reply, status)


def dataset_rows(stage3: DataFrame) -> DataFrame:
    """Evaluation items out of stage 3 rows."""
    failed = (F.col("question_type") == "value") & ~F.col("symbol_contract_validation_passed")
    return stage3.select(
        "id", "original_id", "pair_index", "pair_count", "chapter", "split", "problem_number", "sub_id",
        "source_path", "source_problem_path", F.lit("out_split").alias("source_type"), "question_original",
        "source_problem_latex", "source_answer_latex", "reference_answer_latex_from_by_problem",
        "reference_answer_original", "reference_answer_corrected", "reference_answer_generated_by_llm",
        F.col("pair_question").alias("split_question"), F.col("pair_answer").alias("split_answer"),
        "split_generated_by_llm", "converted_question_before_symbol_sync", "symbol_text_sync_applied",
        "symbol_text_sync_status", "symbol_text_sync_reason",
        F.col("converted_question").alias("question_standalone"), F.col("converted_question").alias("question_final"),
        "question_type", "answer_kind", "comparison_mode", "reference_reasoning",
        F.col("comparable_final_answer").alias("reference_answer"),
        F.col("comparable_final_answer").alias("final_answer_for_compare"),
        "reference_answer_sympy",
        F.col("allowed_symbols").alias("symbol_contract_allowed_symbols"),
        F.col("symbol_definitions").alias("symbol_contract_definitions"),
        "symbol_contract_validation_passed", "symbol_contract_mismatch_symbols", "stage3_retry_count",
        failed.alias("stage3_failed_symbol_contract"),
        F.col("confidence").alias("stage1_confidence"), F.col("confidence").alias("extract_confidence"),
        F.col("llm_json").alias("stage1_json"), "stage2_json", "stage3_json",
    )


def symbolic_or_converted(text: Column, converted: Column) -> Column:
    """An expression usable as it stands, else what the converter made of it."""
    raw = sy.normalize_expression(text)
    return F.when(raw == MISSING, raw).when(an.looks_symbolic(raw), raw).otherwise(
        F.coalesce(_unless_missing(sy.normalize_expression(converted)), raw)
    )
