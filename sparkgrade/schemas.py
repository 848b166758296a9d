"""Schemas of the tables the jobs read, as Spark DDL, and a helper to complete rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATASET = """
id STRING, original_id STRING, pair_index INT, pair_count INT, chapter STRING,
split STRING, problem_number STRING, sub_id STRING, source_path STRING,
source_problem_path STRING, source_type STRING, question_original STRING,
source_problem_latex STRING, source_answer_latex STRING,
reference_answer_latex_from_by_problem STRING, reference_answer_original STRING,
reference_answer_corrected STRING, reference_answer_generated_by_llm BOOLEAN,
split_question STRING, split_answer STRING, split_generated_by_llm BOOLEAN,
converted_question_before_symbol_sync STRING, symbol_text_sync_applied BOOLEAN,
symbol_text_sync_status STRING, symbol_text_sync_reason STRING,
symbol_text_sync_used_symbols ARRAY<STRING>, symbol_text_sync_json STRING,
question_standalone STRING, question_final STRING, question_type STRING,
answer_kind STRING, comparison_mode STRING, reference_reasoning STRING,
reference_answer STRING, final_answer_for_compare STRING, reference_answer_sympy STRING,
reference_answer_json MAP<STRING,STRING>, reference_answer_json_modes MAP<STRING,STRING>,
symbol_contract STRING, symbol_contract_allowed_symbols ARRAY<STRING>,
symbol_contract_definitions MAP<STRING,STRING>,
symbol_contract_validation_passed BOOLEAN, symbol_contract_mismatch_symbols ARRAY<STRING>,
stage3_retry_count INT, stage3_failed_symbol_contract BOOLEAN,
stage1_confidence STRING, extract_confidence STRING,
stage1_json STRING, stage2_json STRING, stage3_json STRING,
points STRING, problem_type_label STRING
"""

GENERATION = """
model STRING, id STRING, split STRING, chapter STRING, question_final STRING,
question_final_used STRING, annotator_rewritten_question STRING,
annotator_rewritten_solution STRING, annotator_rewritten_answer STRING,
annotator_override_active BOOLEAN, answer_kind STRING, question_type STRING,
comparison_mode STRING, model_response STRING, answer_boxed STRING, answer_sympy STRING,
answer_json MAP<STRING,STRING>, final_answer_for_compare STRING, reference_answer STRING,
reference_answer_sympy STRING, reference_answer_json MAP<STRING,STRING>,
reference_answer_json_modes MAP<STRING,STRING>,
symbol_contract_allowed_symbols ARRAY<STRING>, symbol_mismatch BOOLEAN,
mismatch_symbols ARRAY<STRING>, points STRING,
meta STRUCT<model STRING, solver_model_artifact STRING, solve_temperature DOUBLE,
  max_solve_tokens INT, convert_temperature DOUBLE, max_convert_tokens INT>,
workflow_id STRING, run_id STRING, stage STRING, created_at TIMESTAMP
"""

RULE_EVAL = """
model STRING, id STRING, split STRING, assignment_group STRING, question_type STRING,
answer_kind STRING, comparison_mode STRING, prediction STRING, reference STRING,
is_correct BOOLEAN, detail STRING, symbol_contract_allowed_symbols ARRAY<STRING>,
symbol_mismatch BOOLEAN, mismatch_symbols ARRAY<STRING>, reference_symbol_issue BOOLEAN,
reference_mismatch_symbols ARRAY<STRING>,
json_items ARRAY<STRUCT<key STRING, reference STRING, prediction STRING,
  is_correct BOOLEAN, detail STRING>>,
json_missing_keys ARRAY<STRING>, json_extra_keys ARRAY<STRING>,
points DOUBLE, points_earned DOUBLE,
workflow_id STRING, run_id STRING, stage STRING, created_at TIMESTAMP
"""

JUDGE_EVAL = """
model STRING, judge_model STRING, id STRING, split STRING, assignment_group STRING,
question_type STRING, answer_kind STRING, reference_reasoning STRING,
predict_reasoning STRING, reference_answer STRING, predict_answer STRING,
answer_correct BOOLEAN, reasoning_correct BOOLEAN, detail STRING, judge_reason STRING,
points DOUBLE, points_earned DOUBLE
"""

CALL_LOG = """
timestamp_utc TIMESTAMP, run_id STRING, workflow_id STRING, stage STRING,
operation STRING, split STRING, question_id STRING, provider STRING, api_type STRING,
endpoint_or_region STRING, model_requested STRING, attempt INT, status STRING,
latency_ms BIGINT, request_id STRING, model_returned STRING, usage_input_tokens BIGINT,
usage_output_tokens BIGINT, usage_cache_creation_tokens BIGINT,
usage_cache_read_tokens BIGINT, service_tier STRING, raw_usage_json STRING,
error_code STRING, error_message STRING, http_status STRING, solver_model STRING
"""

RUN_SUMMARY = """
run_id STRING, workflow_id STRING, stage STRING, solver_model STRING, command STRING,
config_path STRING, status STRING, error_message STRING, started_at TIMESTAMP,
ended_at TIMESTAMP, call_log_file STRING, summary_file STRING, output_paths ARRAY<STRING>
"""

REVIEW = """
annotator STRING, entries MAP<STRING, STRUCT<question_id: STRING,
  annotator_rewritten_question: STRING, annotator_rewritten_solution: STRING,
  annotator_rewritten_answer: STRING, annotation: STRING,
  annotator_comment: STRING, comment: STRING, saved_at: STRING>>
"""

# One problem file of a source tree; the fields may sit below "problem".
PROBLEM_FIELDS = """
problem_latex STRING, answer_latex STRING, original_number STRING, number STRING,
source_file STRING, subquestion_path ARRAY<STRING>
"""

OVERLAY = """
annotator STRING, annotator_rewritten_question STRING, annotator_rewritten_solution STRING,
annotator_rewritten_answer STRING, annotator_comment STRING,
annotator_rewritten_answer_reference STRING, annotator_rewritten_answer_sympy STRING,
annotator_rewritten_answer_compare STRING
"""


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def complete(df: DataFrame, *ddls: str) -> DataFrame:
    """Add the columns of the schemas that ``df`` lacks, as NULLs."""
    missing = {
        field.name: F.lit(None).cast(field.dataType)
        for ddl in ddls
        for field in struct(ddl).fields
        if field.name not in df.columns
    }
    return df.withColumns(missing) if missing else df
