"""Catalogue: dedupe, pruning, upserts, overlays, reruns, usage, issues, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrade.catalog.registry import everything, items, query, table, text
from sparkgrade.functions import text as tx
from sparkgrade.functions.order import chapter_key, natural_key
from sparkgrade.operators import issues, keys, merge, overlay, rebalance, rerun, usage_totals
from sparkgrade.sources.readers import layered

# Order lines repeat (order, line), so every column takes part in the order of rows.
_LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in _LINE_ORDER)}) = 1
""")
def dedupe_last(spark: SparkSession, folder: str) -> DataFrame:
    """Last row per key."""
    rows = keys.last_per_key(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE_ORDER)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


@query("""
    SELECT CAST(user_id AS VARCHAR) AS id, CASE event_type WHEN 'error' THEN '' ELSE event_type END AS split, event_id
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', ts, event_id) = 1
""")
def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    """First named split per id; ids that only have a blank one keep it."""
    rows = table(spark, folder, "events").select(
        text("user_id").alias("id"), F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("split"),
        "ts", "event_id",
    )
    return keys.first_named_split(rows, ["ts", "event_id"]).select("id", "split", "event_id")


@query("""
    SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Keys held by more than one row."""
    return keys.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
    SELECT l_partkey AS id FROM lineitem GROUP BY 1
    HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)
""")
def common_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Items every model answered."""
    evals = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("model")
    )
    return keys.common_ids(evals)


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS id, lang AS split, source AS chapter FROM documents
    WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)
""")
def pending_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Items without a result."""
    done = table(spark, folder, "labels").select(text("doc_id").alias("id"))
    return merge.pending_rows(items(spark, folder), done, ["id"]).select("id", "split", "chapter")


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS id, quality, toxic FROM labels
    WHERE doc_id NOT IN (SELECT conv_id FROM conversations)
""")
def stale_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Results whose item is not in the dataset (here: the conversations)."""
    output = table(spark, folder, "labels").select(text("doc_id").alias("id"), "quality", "toxic")
    dataset = table(spark, folder, "conversations").select(text("conv_id").alias("id"))
    return merge.stale_rows(output, dataset, ["id"])


_ARTIFACT_SQL = """
    artifacts AS (
      SELECT CASE WHEN n_chars < 500 THEN 'draft' ELSE lang END AS split,
             CASE WHEN lang = 'es' AND source = 'src1' THEN ' ' ELSE CAST(doc_id AS VARCHAR) END AS id, n_chars
      FROM documents),
    dataset AS (SELECT lang AS split, CAST(doc_id AS VARCHAR) AS id FROM documents JOIN labels USING (doc_id))"""


@query(f"""
    WITH {_ARTIFACT_SQL}
    SELECT split, id, n_chars, CASE WHEN trim(id) <> '' AND split IN (SELECT split FROM dataset)
      AND (split, id) NOT IN (SELECT (split, id) FROM dataset) THEN 'removed' ELSE 'kept' END AS status
    FROM artifacts
""")
def prune_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What pruning to the dataset would remove; blank ids and unknown splits stay."""
    docs = table(spark, folder, "documents")
    artifacts = docs.select(
        F.when(F.col("n_chars") < 500, "draft").otherwise(F.col("lang")).alias("split"),
        F.when((F.col("lang") == "es") & (F.col("source") == "src1"), " ").otherwise(text("doc_id")).alias("id"),
        "n_chars",
    )
    dataset = docs.join(table(spark, folder, "labels"), "doc_id").select(
        F.col("lang").alias("split"), text("doc_id").alias("id")
    )
    return merge.prune_plan(artifacts, dataset).select("split", "id", "n_chars", "status")


@query("""
    SELECT d.lang AS split, CAST(l.doc_id AS VARCHAR) AS id, l.quality FROM labels l JOIN documents d USING (doc_id)
    WHERE l.doc_id NOT IN (SELECT conv_id FROM conversations)
""")
def invalidated_evals(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluations that stay valid after some items were answered again."""
    docs = items(spark, folder).select("split", "id")
    evals = table(spark, folder, "labels").select(text("doc_id").alias("id"), "quality").join(docs, "id")
    redone = table(spark, folder, "conversations").select(text("conv_id").alias("id")).distinct().join(docs, "id")
    return merge.drop_evaluations(evals, redone).select("split", "id", "quality")


@query(f"""
    WITH new AS (
      SELECT l_orderkey AS id, l_extendedprice AS value FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, {', '.join(c + ' DESC' for c in _LINE_ORDER)}) = 1),
    old AS (SELECT o_orderkey AS id, o_totalprice AS value FROM orders),
    ranked AS (SELECT o_orderkey AS id, o_custkey AS rank FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT CAST(id AS VARCHAR) AS id, coalesce(new.value, old.value) AS value,
           CASE WHEN rank IS NOT NULL THEN 0 WHEN old.id IS NOT NULL THEN 1 ELSE 2 END AS side, coalesce(rank, -1) AS rank
    FROM old FULL JOIN new USING (id) LEFT JOIN ranked USING (id)
""")
def upsert_rows(spark: SparkSession, folder: str) -> DataFrame:
    """New values replace old ones; output order is dataset, other existing, other new."""
    orders = table(spark, folder, "orders")
    place = F.struct("l_linenumber", *_LINE_ORDER)
    first = F.struct(F.lit(0).alias("l_linenumber"), *[
        F.lit(None).cast(f.dataType).alias(f.name)
        for f in table(spark, folder, "lineitem").select(*_LINE_ORDER).schema.fields
    ])
    old = orders.select(text("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), first.alias("_pos"))
    new = table(spark, folder, "lineitem").select(
        text("l_orderkey").alias("id"), F.col("l_extendedprice").alias("value"), place.alias("_pos")
    )
    order = orders.filter("o_orderpriority = '1-URGENT'").select(
        text("o_orderkey").alias("id"), F.col("o_custkey").alias("_rank")
    )
    merged = merge.upsert_rows(old, new, order)
    return merged.select("id", "value", F.col("_side").alias("side"), F.coalesce("_rank", F.lit(-1)).alias("rank"))


@query("""
    SELECT l_orderkey || '#' || l_linenumber AS id, l_extendedprice AS value FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_totalprice FROM orders WHERE o_orderstatus = 'F'
""")
def replace_by_base(spark: SparkSession, folder: str) -> DataFrame:
    """All parts of a base id give way to its updated row."""
    existing = table(spark, folder, "lineitem").select(
        F.concat_ws("#", text("l_orderkey"), text("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("value")
    )
    done = table(spark, folder, "orders").filter("o_orderstatus = 'F'")
    updated = done.select(text("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return merge.replace_by_base(existing, updated, done.select(text("o_orderkey").alias("base")))


@query("""
    WITH final AS (SELECT lang AS split, CAST(doc_id AS VARCHAR) AS id, source AS label, n_chars FROM documents),
    stage AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id, CASE toxic WHEN 1 THEN 'src1' ELSE 'kept' END AS new FROM labels)
    SELECT split, id, CASE WHEN stage.id IS NULL THEN label ELSE new END AS label, stage.id IS NOT NULL AS targeted,
           stage.id IS NOT NULL AND new <> label AS changed
    FROM final LEFT JOIN stage USING (id)
""")
def paired_update(spark: SparkSession, folder: str) -> DataFrame:
    """Stage rows drive an update of final rows."""
    final = items(spark, folder).select("split", "id", F.col("chapter").alias("label"))
    stage = table(spark, folder, "labels").select(
        text("doc_id").alias("id"), F.when(F.col("toxic") == 1, "src1").otherwise("kept").alias("new")
    )
    return merge.paired_update(final, stage, {"label": "new"}, ["id"]).select("split", "id", "label", "targeted", "changed")


@query("""
    WITH e AS (
      SELECT CAST(conv_id AS VARCHAR) AS id, role, turn, text FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
    SELECT d.lang AS split, CAST(d.doc_id AS VARCHAR) AS id, e.role AS annotator,
           CASE WHEN e.role = 'user' THEN regexp_replace(e.text, '^\\s+|\\s+$', '', 'g')
                ELSE regexp_replace(d.text, '^\\s+|\\s+$', '', 'g') END AS question,
           CASE WHEN e.role = 'assistant' THEN regexp_replace(e.text, '^\\s+|\\s+$', '', 'g') ELSE 'none' END AS reasoning,
           CASE WHEN e.role = 'user' THEN CAST(e.turn AS VARCHAR) WHEN e.role = 'assistant' THEN 'turn ' || e.turn ELSE d.source END AS reference,
           CASE WHEN e.role = 'user' THEN CAST(e.turn AS VARCHAR) WHEN e.role = 'assistant' THEN e.turn || '*x' ELSE 'N/A' END AS symbolic,
           CASE WHEN e.role = 'user' THEN CAST(e.turn AS VARCHAR) WHEN e.role = 'assistant' THEN 'turn ' || e.turn ELSE 'N/A' END AS compare,
           coalesce(e.role IN ('user', 'assistant'), false) AS active
    FROM documents d LEFT JOIN e ON e.id = CAST(d.doc_id AS VARCHAR)
""")
def override_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Items with the latest reviewer entry laid over them."""
    turns = table(spark, folder, "conversations")
    answer = F.when(F.col("role") == "user", text("turn")).when(
        F.col("role") == "assistant",
        F.concat(F.lit('{"sympy": "'), text("turn"), F.lit('*x", "answer": "turn '), text("turn"), F.lit('"}')),
    ).otherwise("{}")
    entries = turns.select(
        text("conv_id").alias("id"), F.col("role").alias("annotator"),
        F.when(F.col("role") == "user", F.col("text")).otherwise(" ").alias("annotator_rewritten_question"),
        F.when(F.col("role") == "assistant", F.col("text")).otherwise("").alias("annotator_rewritten_solution"),
        answer.alias("annotator_rewritten_answer"), F.lit("").alias("annotator_comment"),
        text("turn").alias("saved_at"), "turn",
    )
    latest = keys.last_per_key(entries, ["id"], ["turn"])
    dataset = items(spark, folder).withColumns({
        "question_standalone": F.lit(None).cast("string"), "reference_reasoning": F.lit("none"),
        "reference_answer": F.col("chapter"), "reference_answer_sympy": F.lit("N/A"),
        "final_answer_for_compare": F.lit(" "),
    })
    rows = overlay.apply_overrides(dataset, latest, ["id"])
    return rows.select(
        "split", "id", "annotator", overlay.effective_question().alias("question"),
        overlay.effective_reasoning().alias("reasoning"), overlay.effective_reference().alias("reference"),
        overlay.effective_symbolic().alias("symbolic"), overlay.effective_compare().alias("compare"),
        F.col("annotator_override_active").alias("active"),
    )


@query("""
    WITH layers AS (
      SELECT *, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS layer FROM lineitem),
    best AS (SELECT l_suppkey, l_partkey, min(layer) AS layer FROM layers GROUP BY 1, 2)
    SELECT l_suppkey AS model, l_partkey AS split, l_orderkey, l_linenumber, l_returnflag
    FROM layers JOIN best USING (l_suppkey, l_partkey, layer)
""")
def layered_source(spark: SparkSession, folder: str) -> DataFrame:
    """Per (model, split) only the rows of the first layer that has any."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("model"), F.col("l_partkey").alias("split"), "l_orderkey", "l_linenumber", "l_returnflag"
    )
    return layered([lines.filter(F.col("l_returnflag") == flag) for flag in ("R", "A", "N")])


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    return call_log(table(spark, folder, "events"))


def call_log(events: DataFrame) -> DataFrame:
    """Events as a call log."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.lit("generate").alias("stage"),
        F.when(F.col("event_type") == "view", "generate_solve").otherwise(F.col("event_type")).alias("operation"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        text("user_id").alias("question_id"), text("user_id").alias("run_user"),
        F.lit("w").alias("workflow_id"), (k % 25).cast("string").alias("run_id"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("usage_output_tokens"),
        k.alias("usage_input_tokens"), F.lit(None).cast("bigint").alias("usage_cache_creation_tokens"),
        (k + 1).alias("usage_cache_read_tokens"),
        F.concat(F.lit("m"), F.floor(k / 10).cast("string")).alias("model_requested"),
        text("event_id").alias("request_id"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp_utc"), "ts", "event_id",
    )


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as answer rows: two segments have no boxed answer, one no response."""
    segment = F.col("c_mktsegment")
    return table(spark, folder, "customer").select(
        text("c_custkey").alias("id"), segment.alias("split"), F.lit("w").alias("workflow_id"),
        text("c_nationkey").alias("run_id"),
        F.when(segment == "AUTOMOBILE", " ").otherwise(F.col("c_name")).alias("model_response"),
        F.when(segment.isin("MACHINERY", "HOUSEHOLD"), "N/A").otherwise("1").alias("answer_boxed"),
        F.lit("1").alias("final_answer_for_compare"),
        F.when(F.col("c_nationkey") == 0, "x").otherwise((F.col("c_nationkey") * 3000).cast("string")).alias("max_solve_tokens"),
    )


_COST_SQL = """
    solved AS (
      SELECT CAST(user_id AS VARCHAR) AS id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 25 AS VARCHAR) AS run_id,
             CAST(floor(value * 1000) AS BIGINT) AS used, event_id, ts FROM events WHERE event_type = 'view'),
    exact AS (SELECT * FROM solved QUALIFY row_number() OVER (PARTITION BY id, run_id ORDER BY ts DESC, event_id DESC) = 1),
    by_id AS (SELECT * FROM solved QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1),
    answers AS (
      SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS split, CAST(c_nationkey AS VARCHAR) AS run_id,
             c_mktsegment IN ('MACHINERY', 'HOUSEHOLD', 'AUTOMOBILE') AS missing,
             CASE WHEN c_nationkey = 0 THEN 32768 ELSE c_nationkey * 3000 END AS budget FROM customer),
    costed AS (
      SELECT a.*, coalesce(e.used, b.used) AS used, coalesce(e.event_id, b.event_id) AS event_id,
             greatest(1, CAST(ceil(budget::DOUBLE * 0.98) AS BIGINT)) AS threshold
      FROM answers a LEFT JOIN exact e ON e.id = a.id AND e.run_id = a.run_id LEFT JOIN by_id b ON b.id = a.id)"""


@query(f"""
    WITH {_COST_SQL}
    SELECT id, split, coalesce(used, -1) AS usage_output_tokens, CAST(event_id AS VARCHAR) AS request_id FROM costed
""")
def cost_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The call behind each answer: same run and id, else the latest of the id."""
    calls = rerun.solve_calls(_calls(spark, folder))
    rows = rerun.attach_cost(_answers(spark, folder), calls, ["ts", "event_id"])
    return rows.select(
        "id", "split", F.coalesce("cost.usage_output_tokens", F.lit(-1)).alias("usage_output_tokens"),
        F.col("cost.request_id").alias("request_id"),
    )


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    rows = rerun.attach_cost(
        _answers(spark, folder), rerun.solve_calls(_calls(spark, folder)), ["ts", "event_id"]
    )
    return rerun.token_limit_status(rows, 32768)


@query(f"""
    WITH {_COST_SQL}
    SELECT id, split, used AS usage_output_tokens, CAST(budget AS BIGINT) AS max_solve_tokens,
           CAST(threshold AS BIGINT) AS threshold_tokens, CAST(event_id AS VARCHAR) AS request_id,
           split = 'AUTOMOBILE' AS model_response_empty
    FROM costed WHERE missing AND used >= threshold
""")
def token_limit_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that are missing and used up their token budget."""
    return rerun.token_limit_rows(_classified(spark, folder)).select(
        "id", "split", "usage_output_tokens", "max_solve_tokens", "threshold_tokens", "request_id", "model_response_empty"
    )


@query(f"""
    WITH {_COST_SQL}
    SELECT coalesce(split, 'ALL') AS split, count(*) AS rows_scanned, count(*) FILTER (missing) AS missing_answer_rows,
           count(*) FILTER (missing AND used IS NULL) AS missing_without_cost,
           count(*) FILTER (missing AND used < threshold) AS missing_below_threshold,
           count(*) FILTER (missing AND used >= threshold) AS selected_rows
    FROM costed GROUP BY GROUPING SETS ((split), ())
""")
def token_limit_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """How many answers each step of the selection leaves, per split and overall."""
    funnel = rerun.token_limit_funnel(_classified(spark, folder))
    return funnel.select(everything("split").alias("split"), "rows_scanned", "missing_answer_rows",
                         "missing_without_cost", "missing_below_threshold", "selected_rows")


@query("""
    WITH picked AS (
      SELECT event_type AS split, CAST(user_id AS VARCHAR) AS id, 0 AS list, event_id FROM events
      WHERE event_type IN ('error', 'purchase')
      UNION ALL SELECT '', CAST(doc_id AS VARCHAR), 1, NULL FROM labels WHERE toxic = 1)
    SELECT split, id FROM picked QUALIFY row_number() OVER (PARTITION BY id ORDER BY split = '', list, event_id) = 1
""")
def rerun_list(spark: SparkSession, folder: str) -> DataFrame:
    """Ids whose detail matches a failure pattern, plus a manual list, each once."""
    kind = F.col("event_type")
    detail = F.when(kind == "error", "SymPy_Parse_Failed: line 1").when(kind == "purchase", "json_reference_invalid").otherwise(
        F.lit("sympy_equal")
    )
    evals = table(spark, folder, "events").select(
        kind.alias("split"), text("user_id").alias("id"), detail.alias("detail"), F.col("event_id").alias("_pos")
    )
    manual = table(spark, folder, "labels").filter("toxic = 1").select(text("doc_id").alias("id"))
    return rerun.rerun_by_pattern(evals, manual)


USAGE_SQL = """
    SELECT CAST(user_id AS VARCHAR) AS run_id,
           CASE WHEN grouping(m) = 0 THEN 'model' WHEN grouping(op) = 0 THEN 'operation' ELSE 'total' END AS level,
           coalesce(m, op, '') AS name, count(*) AS api_call_count, count(*) FILTER (event_type <> 'error') AS success_count,
           count(*) FILTER (event_type = 'error') AS error_count, CAST(sum(k) AS BIGINT) AS total_input_tokens,
           CAST(sum(floor(value * 1000)) AS BIGINT) AS total_output_tokens, CAST(0 AS BIGINT) AS total_cache_creation_tokens,
           CAST(sum(k + 1) AS BIGINT) AS total_cache_read_tokens
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
                 'm' || CAST(floor(CAST(json_extract_string(props, '$.k') AS BIGINT) / 10) AS BIGINT) AS m,
                 CASE event_type WHEN 'view' THEN 'generate_solve' ELSE event_type END AS op FROM events)
    GROUP BY GROUPING SETS ((user_id, m), (user_id, op), (user_id))
"""


@query(USAGE_SQL)
def usage_totals_by_run(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, errors and tokens per run, and per run by model and by operation."""
    calls = _calls(spark, folder).withColumn("run_id", F.col("run_user"))
    return usage_totals.usage_totals(calls)


@query("""
    WITH entries AS (
      SELECT strftime(ts, '%Y-%m-%d') AS workflow_id, user_id, event_type, ts FROM events
      QUALIFY row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT workflow_id, count(*) AS runs, count(*) FILTER (event_type <> 'error') AS successful_runs,
           strftime(min(ts), '%H:%M:%S') AS first_started_at, strftime(max(ts), '%H:%M:%S') AS last_ended_at
    FROM entries GROUP BY 1
""")
def run_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Latest entry of each run, summed up per workflow."""
    runs = _calls(spark, folder).select(
        F.col("timestamp_utc").alias("workflow_id"), F.col("run_user").alias("run_id"), "status",
        F.col("ts").alias("started_at"), F.col("ts").alias("ended_at"), "ts", "event_id",
    )
    manifest = usage_totals.workflow_manifest(usage_totals.run_entries(runs, ["ts", "event_id"]))
    return manifest.select(
        "workflow_id", "runs", "successful_runs",
        F.date_format("first_started_at", "HH:mm:ss").alias("first_started_at"),
        F.date_format("last_ended_at", "HH:mm:ss").alias("last_ended_at"),
    )


def _issues(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON assessments, taken apart into issues."""
    issue = F.struct(
        F.when(F.col("event_type") == "click", "Warning").otherwise(F.col("event_type")).alias("severity"),
        F.concat(F.lit("Code - "), F.get_json_object("props", "$.k")).alias("code"),
        F.lit(" ").alias("message"),
    )
    block = F.struct(F.array(issue).alias("issues"))
    purchase = F.col("event_type") == "purchase"
    assessment = F.to_json(F.struct(
        F.when(~purchase, block).alias("conversion"),
        F.when(purchase | (F.col("event_type") == "error"), block).alias("extraction"),
        F.struct(F.col("value").cast("string").alias("score")).alias("overall"),
    ))
    return table(spark, folder, "events").select(
        F.col("event_type").alias("split"), text("event_id").alias("id"), assessment.alias("assessment")
    )


_ISSUES_SQL = """
    issues AS (
      SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'error' ELSE 'warn' END AS severity,
             'code_' || json_extract_string(props, '$.k') AS code, unnest(CASE event_type WHEN 'purchase' THEN ['extraction']
               WHEN 'error' THEN ['conversion', 'extraction'] ELSE ['conversion'] END) AS stage
      FROM events)"""


@query(f"""
    WITH {_ISSUES_SQL}
    SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM issues GROUP BY ALL
    UNION ALL SELECT 'code', code, count(*) FROM issues GROUP BY ALL
    UNION ALL SELECT 'stage', stage, count(*) FROM issues GROUP BY ALL
""")
def issue_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Issue counts by severity, code and stage."""
    return issues.issue_rollup(issues.issues_from_assessment(_issues(spark, folder)))


@query(f"""
    WITH {_ISSUES_SQL}
    SELECT code, count(*) AS n FROM issues GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 30
""")
def top_issue_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty most frequent issue codes."""
    found = issues.issues_from_assessment(_issues(spark, folder))
    return issues.top_codes(found, F.col("id").cast("bigint"))


@query(f"""
    WITH {_ISSUES_SQL}
    SELECT event_type AS split, CAST(event_id AS VARCHAR) AS id, count(*) AS issues,
           count(*) FILTER (severity = 'error') AS errors, min(stage || ' issue flagged by LLM') AS message
    FROM issues GROUP BY 1, 2
""")
def issues_per_row(spark: SparkSession, folder: str) -> DataFrame:
    """Issues per item."""
    found = issues.issues_from_assessment(_issues(spark, folder))
    first = found.groupBy("split", "id").agg(F.min("message").alias("message"))
    return issues.issues_per_row(found).join(first, ["split", "id"])


@query("SELECT count(value) AS scored_rows, round(avg(value), 4) AS mean_score FROM events")
def mean_score(spark: SparkSession, folder: str) -> DataFrame:
    """Mean score of the assessments."""
    return issues.mean_score(_issues(spark, folder)).withColumn("mean_score", F.round("mean_score", 4))


def _mixed_id() -> Column:
    """Customer and order number as an id whose text order differs from its natural order."""
    return F.concat(text("o_custkey"), F.lit(".Order"), text("o_orderkey"), F.lit("/i"))


@query("""
    SELECT o_custkey || '.Order' || o_orderkey || '/i' AS id, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rank
    FROM orders
""")
def natural_sort(spark: SparkSession, folder: str) -> DataFrame:
    """Rank of every id in natural order, numbered without a single-task sort."""
    ids = table(spark, folder, "orders").select(_mixed_id().alias("id"))
    return keys.global_rank(ids, [natural_key("id"), "id"])


@query("""
    WITH s AS (
      SELECT DISTINCT CASE WHEN n_nationkey = 0 THEN 'chapter_intro' WHEN n_regionkey = 1 THEN 'appendix_' || n_name
             ELSE 'chapter_' || n_nationkey END AS split, n_nationkey, n_regionkey, n_name FROM nation)
    SELECT split, row_number() OVER (ORDER BY CASE WHEN n_nationkey = 0 THEN -1 WHEN n_regionkey = 1 THEN 9999 ELSE n_nationkey END, split) AS place
    FROM s
""")
def chapter_order(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters in report order: introduction, numbers, the rest."""
    number = F.col("n_nationkey")
    split = F.when(number == 0, "chapter_intro").when(
        F.col("n_regionkey") == 1, F.concat(F.lit("appendix_"), "n_name")
    ).otherwise(F.concat(F.lit("chapter_"), text("n_nationkey")))
    splits = table(spark, folder, "nation").select(split.alias("split")).distinct()
    return keys.global_rank(splits, [chapter_key("split")], "place")


@query("""
    SELECT lang AS split, CAST(doc_id AS VARCHAR) AS id,
           CASE WHEN length(t) <= 200 THEN t ELSE left(t, 197) || '...' END AS question, CAST(n AS INT) AS n
    FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)
    WHERE n <= 3
""")
def head_per_split(spark: SparkSession, folder: str) -> DataFrame:
    """Preview of the first three items of each split."""
    head = keys.head_per_group(items(spark, folder), ["split"], [F.asc("_pos")], 3)
    return head.select("split", "id", tx.shorten("question_final", 200).alias("question"), F.col("row_number").alias("n"))


@query("""
    SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':' || 42), o_orderkey LIMIT 100
""")
def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded sample of one hundred rows."""
    return keys.sample_rows(table(spark, folder, "orders").select("o_orderkey"), 100, 42, ["o_orderkey"])


_FLIPS_SQL = """
    judged AS (
      SELECT d.lang AS split, CAST(d.doc_id AS VARCHAR) AS id, CASE l.quality WHEN 1 THEN 'True' ELSE 'False' END AS label
      FROM labels l JOIN documents d USING (doc_id)),
    counts AS (SELECT count(*) FILTER (label = 'True') AS t, count(*) FILTER (label = 'False') AS f FROM judged),
    planned AS (
      SELECT split, id, label FROM (
        SELECT j.*, row_number() OVER (ORDER BY md5(split || ':' || id || ':' || 42), split, id) AS n
        FROM judged j, counts WHERE label = CASE WHEN t >= f THEN 'True' ELSE 'False' END), counts
      WHERE n <= abs(t - f) // 2)"""


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select(text("doc_id").alias("id"), text("quality").alias("reference_answer"))
    rows = items(spark, folder).join(labels, "id").withColumns({
        "question_type": F.lit("judge"), "reference_answer_sympy": F.lit("s"),
    })
    return rows.withColumn("label", rebalance.judge_label(rows.columns))


@query(f"WITH {_FLIPS_SQL} SELECT split, id, label FROM planned")
def rebalance_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Judge questions whose label should flip so that both labels are equally common."""
    return rebalance.rebalance_plan(_judged(spark, folder)).select("split", "id", "label")


@query(f"""
    WITH {_FLIPS_SQL}
    SELECT j.split, j.id, p.id IS NOT NULL AS flipped,
           CASE WHEN p.id IS NULL THEN CASE j.label WHEN 'True' THEN '1' ELSE '0' END
                WHEN p.label = 'True' THEN 'False' ELSE 'True' END AS reference_answer,
           CASE WHEN p.id IS NULL THEN d.text ELSE 'Not: ' || regexp_replace(d.text, '^\\s+|\\s+$', '', 'g') END AS question_final,
           CASE WHEN p.id IS NULL THEN 's' ELSE 'N/A' END AS reference_answer_sympy
    FROM judged j LEFT JOIN planned p USING (split, id) JOIN documents d ON CAST(d.doc_id AS VARCHAR) = j.id
""")
def flip_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Planned rewrites put into question and answer columns."""
    judged = _judged(spark, folder)
    planned = rebalance.rebalance_plan(judged)
    reply = F.to_json(F.struct(
        F.concat(F.lit("Not: "), tx.strip("question_final")).alias("rewritten_question"),
        tx.flip_bool("label").alias("new_label"), F.lit("yes").alias("flipped"), F.lit(True).alias("natural"),
    ))
    accepted = rebalance.accepted_rewrites(planned.withColumn("reply", reply), "reply")
    flipped = rebalance.apply_flips(judged, accepted)
    return flipped.select("split", "id", "flipped", "reference_answer", "question_final", "reference_answer_sympy")
