"""Token usage and error fields read from a provider's raw JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgrade.functions import text as tx
from sparkgrade.functions.text import as_column

RESPONSE = """
usage STRUCT<input_tokens: BIGINT, prompt_tokens: BIGINT, output_tokens: BIGINT, completion_tokens: BIGINT,
  cache_creation_input_tokens: BIGINT, cache_creation: STRUCT<ephemeral_5m_input_tokens: BIGINT>,
  cache_read_input_tokens: BIGINT, service_tier: STRING>, service_tier STRING
"""
ERROR = """
code STRING, message STRING, status_code STRING, body STRUCT<error: STRUCT<code: STRING, message: STRING>>
"""


def _first_count(*counts: Column) -> Column:
    """First count that is neither NULL nor zero, else 0."""
    present = F.array_remove(F.array_compact(F.array(*counts)), F.lit(0).cast("bigint"))
    return F.coalesce(F.get(present, F.lit(0)), F.lit(0).cast("bigint"))


def usage_fields(raw: Column | str) -> dict[str, Column]:
    parsed = F.from_json(as_column(raw), RESPONSE)
    counts = parsed["usage"]
    return {
        "usage_input_tokens": _first_count(counts["input_tokens"], counts["prompt_tokens"]),
        "usage_output_tokens": _first_count(counts["output_tokens"], counts["completion_tokens"]),
        "usage_cache_creation_tokens": _first_count(
            counts["cache_creation_input_tokens"], counts["cache_creation"]["ephemeral_5m_input_tokens"]
        ),
        "usage_cache_read_tokens": _first_count(counts["cache_read_input_tokens"]),
        "service_tier": F.coalesce(tx.first_text(counts["service_tier"], parsed["service_tier"]), F.lit("")),
        "raw_usage_json": F.get_json_object(as_column(raw), "$.usage"),
    }


def error_fields(raw: Column | str) -> dict[str, Column]:
    parsed = F.from_json(as_column(raw), ERROR)
    inner = parsed["body"]["error"]

    def text(*values: Column) -> Column:
        return F.coalesce(tx.first_text(*values), F.lit(""))

    return {
        "error_code": text(parsed["code"], inner["code"]),
        "error_message": text(parsed["message"], inner["message"]),
        "http_status": text(parsed["status_code"]),
    }
