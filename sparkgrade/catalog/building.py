"""Catalogue: scorer surface, dataset stages, confirmed items, files, streams.

The stub scorers are small pure functions of the request, so SQL can say what they answer.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrade import schemas
from sparkgrade.catalog.registry import items, query, table, text
from sparkgrade.catalog.upkeep import USAGE_SQL, call_log
from sparkgrade.operators import build, confirm, scoring, usage_totals
from sparkgrade.plans.build import build_dataset
from sparkgrade.session import cut_lineage, new_table_path
from sparkgrade.sources import readers, writers
from sparkgrade.streaming import incremental, totals


def length_stub() -> Callable[[str], str]:
    """Answers with the number of characters; texts with ``###`` are refused."""
    def call(request: str) -> str:
        if "###" in request:
            raise ValueError("refused")
        return str(len(request))

    return call


def batch_stub() -> Callable[[list[str]], list[str]]:
    return lambda requests: [r[::-1] for r in requests]


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    docs = items(spark, folder)
    scored = docs.withColumn("scored", scoring.score("question_final", length_stub, max_attempts=2))
    return cut_lineage(scored.select("split", "id", "scored"), "scored")


@query("""
    SELECT lang AS split, CAST(doc_id AS VARCHAR) AS id,
           CASE WHEN NOT contains(text, '###') THEN CAST(length(text) AS VARCHAR) END AS response,
           CASE WHEN contains(text, '###') THEN 'error' ELSE 'success' END AS status,
           CASE WHEN contains(text, '###') THEN 2 ELSE 1 END AS attempts
    FROM documents
""")
def scorer_stub(spark: SparkSession, folder: str) -> DataFrame:
    """A callable applied to every row, failures caught per row."""
    return _scored(spark, folder).select("split", "id", "scored.response", "scored.status", "scored.attempts")


@query("""
    SELECT lang AS split, CAST(doc_id AS VARCHAR) AS id, 'ValueError: refused' AS error, 2 AS attempts
    FROM documents WHERE contains(text, '###')
""")
def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that failed for good."""
    return scoring.dead_letters(_scored(spark, folder), ["split", "id"])


@query("""
    SELECT lang AS split, CAST(doc_id AS VARCHAR) AS id, 1 AS attempt,
           CASE WHEN contains(text, '###') THEN 'error' ELSE 'success' END AS status FROM documents
    UNION ALL SELECT lang, CAST(doc_id AS VARCHAR), 2, 'error' FROM documents WHERE contains(text, '###')
""")
def attempt_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row per attempt."""
    return scoring.call_log(_scored(spark, folder), ["split", "id"]).select("split", "id", "attempt", "status")


@query("""
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN reverse(text) END AS response,
           CASE WHEN role = 'user' THEN 'success' ELSE 'skipped' END AS status FROM conversations
""")
def batch_scorer(spark: SparkSession, folder: str) -> DataFrame:
    """Rows answered a batch at a time; rows without a request are skipped."""
    turns = table(spark, folder, "conversations").repartition(8)
    request = F.when(F.col("role") == "user", F.col("text"))
    return turns.withColumn("s", scoring.score_batches(request, batch_stub, 7)).select(
        "conv_id", "turn", "s.response", "s.status"
    )


@query("""
    WITH lines AS (
      SELECT CAST(doc_id AS VARCHAR) AS base, lang AS split, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body,
             unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n,
             len(string_split(text, chr(10))) AS total FROM documents)
    SELECT split, CASE WHEN total > 1 THEN base || '#' || n ELSE base END AS id, base AS original_id, CAST(n AS INT) AS pair_index,
           CAST(total AS INT) AS pair_count,
           coalesce(nullif(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), ''), body) AS pair_question,
           coalesce(nullif(trim(regexp_replace(line, '\\s+', ' ', 'g')), ''), 'whole') AS pair_answer
    FROM lines
""")
def pair_explode(spark: SparkSession, folder: str) -> DataFrame:
    """One item per part; the id gains ``#n`` only when there are several."""
    rows = items(spark, folder).select(
        "id", "split", F.col("question_final").alias("question_original"),
        F.lit("whole").alias("reference_answer_corrected"),
        F.transform(
            F.split("question_final", "\n"),
            lambda line: F.struct(line.alias("question"), line.alias("answer")),
        ).alias("pairs"),
    )
    return build.explode_pairs(rows).select(
        "split", "id", "original_id", "pair_index", "pair_count", "pair_question", "pair_answer"
    )


def _payload(request: str) -> dict:
    return json.loads(request.split("\n", 1)[1])


def check_stub() -> Callable[[str], str]:
    """Confirms the reference, or refuses texts with ``###``."""
    def call(request: str) -> str:
        payload = _payload(request)
        if "###" in payload["question"]:
            raise ValueError("refused")
        return json.dumps({"final_reference_answer": payload["reference"] + " ", "confidence": "High"})

    return call


def split_stub() -> Callable[[str], str]:
    """Two parts for a question of more than 1000 characters."""
    def call(request: str) -> str:
        if len(_payload(request)["question"]) <= 1000:
            return "{}"
        parts = [{"question": "Find it.", "answer": "a*b"}, {"sub_index": 2, "question": "True or false?", "answer": ""}]
        return "```json\n" + json.dumps({"pairs": parts, "question_count": 2}) + "\n```"

    return call


def convert_stub() -> Callable[[str], str]:
    """A verdict for the second part; a product for others, whose contract the repair completes."""
    def call(request: str) -> str:
        payload = _payload(request)
        if "True or false?" in payload["question"]:
            return json.dumps({"question_type": "Judge", "reference_answer": "yes"})
        allowed = ["a", "b"] if "repair" in payload else ["a"]
        return json.dumps({
            "question_type": "value", "reference_answer_sympy": "a*b",
            "symbol_contract": {"allowed_symbols": allowed, "symbol_definitions": {"a": "first"}},
        })

    return call


def align_stub() -> Callable[[str], str]:
    """Returns long questions as they are, cuts short ones."""
    def call(request: str) -> str:
        question = _payload(request)["converted_question"]
        return json.dumps({"rewritten_question": question if len(question) > 500 else "cut", "changed": False})

    return call


def _built(spark: SparkSession, folder: str):
    problems = items(spark, folder).select(
        "id", "split", "chapter", F.lit("1").alias("problem_number"), F.lit("main").alias("sub_id"),
        F.lit("p").alias("source_path"), F.lit("").alias("source_problem_path"),
        F.trim("question_final").alias("question_original"), F.lit("").alias("source_problem_latex"),
        F.lit("").alias("source_answer_latex"), F.lit("").alias("reference_answer_latex_from_by_problem"),
        F.col("chapter").alias("reference_answer_original"),
    )
    return build_dataset(problems, check_stub, split_stub, convert_stub, align_stub)


_BUILT_SQL = """
    problems AS (
      SELECT CAST(doc_id AS VARCHAR) AS base, lang AS split, trim(text) AS question, length(trim(text)) > 1000 AS two FROM documents),
    parts AS (
      SELECT base, split, question, two, 1 AS pair_index FROM problems
      UNION ALL SELECT base, split, question, two, 2 FROM problems WHERE two),
    built AS (
      SELECT split, CASE WHEN two THEN base || '#' || pair_index ELSE base END AS id, base AS original_id, pair_index,
             CASE WHEN two THEN 2 ELSE 1 END AS pair_count, pair_index = 2 AS judge,
             CASE WHEN two AND pair_index = 1 THEN question || E'\\n\\n[Split target 1] Find it.'
                  WHEN two THEN question || E'\\n\\n[Split target 2] True or false?' ELSE question END AS part
      FROM parts),
    final AS (
      SELECT *, CASE WHEN judge THEN part ELSE part || E'\\n\\nSymbols (for final answer):\\n- `a`: first\\n- `b`' END AS question_final
      FROM built)"""


@query(f"""
    WITH {_BUILT_SQL}
    SELECT split, id, original_id, CAST(pair_index AS INT) AS pair_index, CAST(pair_count AS INT) AS pair_count,
           CASE WHEN judge THEN 'judge' ELSE 'value' END AS question_type, CASE WHEN judge THEN 'exact' ELSE 'sympy' END AS comparison_mode,
           CASE WHEN judge THEN 'True' ELSE 'a*b' END AS reference_answer, CASE WHEN judge THEN 0 ELSE 1 END AS stage3_retry_count,
           true AS symbol_contract_validation_passed, question_final,
           CASE WHEN judge THEN 'skipped'
                WHEN length(question_final) <= 500 AND length('cut' || E'\\n\\nSymbols (for final answer):\\n- `a`: first\\n- `b`')
                     < greatest(50, CAST(floor(length(question_final) * 0.35) AS INT)) THEN 'fallback' ELSE 'ok' END AS sync_status
    FROM final WHERE judge OR length(question_final) > 500
       OR length('cut' || E'\\n\\nSymbols (for final answer):\\n- `a`: first\\n- `b`') < greatest(50, CAST(floor(length(question_final) * 0.35) AS INT))
    UNION ALL
    SELECT split, id, original_id, CAST(pair_index AS INT), CAST(pair_count AS INT), 'value', 'sympy', 'a*b', 1, true,
           'cut' || E'\\n\\nSymbols (for final answer):\\n- `a`: first\\n- `b`', 'ok'
    FROM final WHERE NOT judge AND length(question_final) <= 500
       AND length('cut' || E'\\n\\nSymbols (for final answer):\\n- `a`: first\\n- `b`') >= greatest(50, CAST(floor(length(question_final) * 0.35) AS INT))
""")
def build_items(spark: SparkSession, folder: str) -> DataFrame:
    """The whole dataset chain with stub scorers: split, converted, repaired and aligned items."""
    return _built(spark, folder).items.select(
        "split", "id", "original_id", "pair_index", "pair_count", "question_type", "comparison_mode", "reference_answer",
        "stage3_retry_count", "symbol_contract_validation_passed", "question_final",
        F.col("symbol_text_sync_status").alias("sync_status"),
    )


@query(f"""
    WITH {_BUILT_SQL}
    SELECT split, count(DISTINCT original_id) AS stage1, count(DISTINCT original_id) AS stage2, count(*) AS stage3, count(*) AS final
    FROM final GROUP BY 1
""")
def build_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per split in every stage of the chain."""
    return _built(spark, folder).counts()


def _confirmed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = items(spark, folder)
    export = table(spark, folder, "labels").select(
        text("doc_id").alias("id"), F.when(F.col("toxic") == 1, " 5 ").otherwise("").alias("comment"),
        F.when(F.col("quality") == 0, F.array(F.lit("1"), F.lit("5"))).alias("codes"),
    )
    expert = table(spark, folder, "conversations").groupBy(text("conv_id").alias("id")).agg(
        F.count_if(F.col("role") == "system").alias("system"), F.count("*").alias("n")
    ).select("id", (F.col("n") <= 3).alias("silent"))
    explicit = table(spark, folder, "benchmark").select(text("item_id").alias("id"))
    excluded = table(spark, folder, "supplier").select(text("s_suppkey").alias("id"))
    candidates = confirm.bucket_candidates(export, expert, explicit, excluded)
    resolved = confirm.resolve_candidates(candidates, base, export, expert)
    return base, resolved, confirm.confirmed_items(resolved)


_CONFIRMED_SQL = """
    base AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS split FROM documents),
    export AS (SELECT CAST(doc_id AS VARCHAR) AS id, toxic = 1 OR quality = 0 AS coded FROM labels),
    expert AS (SELECT CAST(conv_id AS VARCHAR) AS id, count(*) <= 3 AS silent FROM conversations GROUP BY 1),
    explicit AS (SELECT CAST(item_id AS VARCHAR) AS id FROM benchmark),
    candidates AS (
      SELECT id, 1 AS bucket FROM export WHERE coded
      UNION ALL SELECT id, 2 FROM explicit
      UNION ALL SELECT id, 3 FROM expert WHERE silent AND id NOT IN (SELECT id FROM explicit)
        AND id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)),
    resolved AS (
      SELECT id, bucket, CASE WHEN id NOT IN (SELECT id FROM base) THEN 'missing_base'
        WHEN bucket > 1 AND id NOT IN (SELECT id FROM export) THEN 'missing_export'
        WHEN bucket > 1 AND id NOT IN (SELECT id FROM expert) THEN 'missing_expert' ELSE 'selected' END AS status FROM candidates),
    chosen AS (
      SELECT id, ['non_expert_comment_5', 'expert_explicitly_correct', 'expert_silent_no_change'][max(bucket)] AS confirmation_bucket,
             CASE WHEN max(bucket) = 1 THEN 'confirmed_without_expert' ELSE 'confirmed_by_expert' END AS confirmation_status
      FROM resolved WHERE status = 'selected' GROUP BY 1)"""


@query(f"WITH {_CONFIRMED_SQL} SELECT split, id, confirmation_bucket, confirmation_status FROM chosen JOIN base USING (id)")
def confirmed_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items confirmed by a reviewer's code, an explicit list, or an expert's silence."""
    base, _, chosen = _confirmed(spark, folder)
    return chosen.join(base.select("id", "split"), "id").select("split", "id", "confirmation_bucket", "confirmation_status")


@query(f"""
    WITH {_CONFIRMED_SQL}, out AS (SELECT * FROM chosen JOIN base USING (id))
    SELECT 'bucket' AS section, confirmation_bucket AS name, count(*) AS n FROM out GROUP BY ALL
    UNION ALL SELECT 'split', split, count(*) FROM out GROUP BY ALL
    UNION ALL SELECT 'missing', status, count(*) FROM resolved WHERE status <> 'selected' GROUP BY ALL
""")
def confirmed_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Totals by bucket and split, and candidates each table lacked."""
    base, resolved, chosen = _confirmed(spark, folder)
    return confirm.manifest(chosen.join(base.select("id", "split"), "id"), resolved)


@query("""
    SELECT CAST(d.doc_id AS VARCHAR) AS id,
      CASE WHEN b.item_id IS NULL THEN d.text
           ELSE regexp_replace(replace(d.text, 'the', 'THE'), '\\s+$', '') || E'\\n\\nReturn the final answer as a JSON object with exactly these keys: q1, q2. Use double-quoted JSON keys and string values.' END AS question_final,
      CASE WHEN b.item_id IS NULL THEN 'text' ELSE 'json' END AS answer_kind
    FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id
""")
def patched_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per-id corrections: replaced values, replaced text, an instruction appended once."""
    base = items(spark, folder).withColumn("answer_kind", F.lit("text"))
    patches = table(spark, folder, "benchmark").select(
        text("item_id").alias("id"), F.lit("json").alias("answer_kind"), F.lit("the").alias("replace_from"),
        F.lit("THE").alias("replace_to"), F.array(F.lit("q1"), F.lit("q2")).alias("json_keys"),
    )
    patched = confirm.apply_patches(base, patches, ["answer_kind"])
    # A second application must not append the instruction again.
    again = confirm.apply_patches(patched, patches.drop("replace_from", "replace_to"), ["answer_kind"])
    return again.select("id", "question_final", "answer_kind")


@query("""
    SELECT CAST(d.doc_id AS VARCHAR) AS id,
      CASE WHEN l.quality = 1 THEN 'New question' ELSE 'old' END AS question_final,
      CASE WHEN l.doc_id IS NULL THEN 'true' WHEN l.toxic = 1 THEN 'false' ELSE 'x + 1' END AS reference_answer
    FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def materialised_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Reviewed values in the base columns; a boolean stays one where the review spells one."""
    base = items(spark, folder).select("id").withColumns({
        c: F.lit("old") for c in ("question_standalone", "question_final", "reference_reasoning", "reference_answer_sympy", "final_answer_for_compare")
    }).withColumn("reference_answer", F.lit("true"))
    reviews = table(spark, folder, "labels").select(
        text("doc_id").alias("id"), F.when(F.col("quality") == 1, " New  question").otherwise(" ").alias("question"),
        F.lit(None).cast("string").alias("reasoning"),
        F.when(F.col("toxic") == 1, "False").otherwise("x  + 1").alias("answer_reference"),
        F.lit("").alias("answer_sympy"), F.lit("").alias("answer_compare"),
    )
    return confirm.materialise_reviews(base, reviews).select("id", "question_final", "reference_answer")


@query("""
    WITH p AS (
      SELECT CAST(doc_id AS VARCHAR) AS problem_number, lang AS chapter, source || '.json' AS named, doc_id FROM documents),
    parents AS (SELECT lang AS chapter, source || '.json' AS file, max(n_chars) AS n FROM documents WHERE source < 'src15' GROUP BY ALL
      UNION ALL SELECT d.lang, CAST(doc_id AS VARCHAR) || '.json', -1 FROM documents d JOIN labels USING (doc_id))
    SELECT problem_number || '/main' AS id, 'chapter_' || p.chapter AS split,
           coalesce('parent ' || a.n, 'parent ' || b.n, '') AS parent
    FROM p LEFT JOIN parents a ON a.chapter = p.chapter AND a.file = named
    LEFT JOIN parents b ON b.chapter = p.chapter AND b.file = problem_number || '.json'
""")
def parent_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Problems with the parent text of their named source file, else of their own number."""
    docs = table(spark, folder, "documents")
    file = F.concat("source", F.lit(".json"))
    files = docs.select(
        F.col("lang").alias("chapter"), text("doc_id").alias("folder"), F.lit("main").alias("stem"), F.lit("p").alias("path"),
        F.col("text").alias("problem_latex"), F.lit("").alias("answer_latex"), F.lit(None).cast("string").alias("original_number"),
        F.lit(" ").alias("number"), file.alias("source_file"), F.lit(None).cast("array<string>").alias("subquestion_path"),
    )
    named = docs.filter("source < 'src15'").groupBy(F.col("lang").alias("chapter"), file.alias("file")).agg(F.max("n_chars").alias("n"))
    own = docs.join(table(spark, folder, "labels"), "doc_id").select(
        F.col("lang").alias("chapter"), F.concat(text("doc_id"), F.lit(".json")).alias("file"), F.lit(-1).cast("bigint").alias("n")
    )
    parents = named.unionByName(own).select(
        "chapter", "file", F.lit("q").alias("path"), F.concat(F.lit("parent "), text("n")).alias("problem_latex"),
        F.lit(None).cast("string").alias("answer_latex"),
    )
    rows = build.problem_rows(files, parents)
    return rows.select("id", "split", F.col("source_problem_latex").alias("parent"))


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS id,
      CASE WHEN lang = 'en' THEN 'recorded' WHEN lang = 'fr' THEN 'implied' WHEN lang = 'de' THEN 'main' END AS source
    FROM documents
""")
def source_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Sources found by recorded path, else by the path the ids imply; the rest has none."""
    docs = table(spark, folder, "documents")
    number = text("doc_id")
    rows = docs.select(
        number.alias("id"), F.col("lang").alias("chapter"), number.alias("problem_number"),
        F.when(F.col("lang") == "fr", "ii").otherwise("i.json").alias("sub_id"),
        F.concat(F.lit("/old/datasets/chapters/en/"), number, F.lit(".json")).alias("source_path"),
    )
    key = (
        F.when(F.col("lang") == "en", F.concat(F.lit("en/"), number, F.lit(".json")))
        .when(F.col("lang") == "fr", F.concat(F.lit("fr/out_split/"), number, F.lit("/ii.json")))
        .when(F.col("lang") == "de", F.concat(F.lit("de/out_split/"), number, F.lit("/main.json")))
    )
    names = F.when(F.col("lang") == "en", "recorded").when(F.col("lang") == "fr", "implied").otherwise("main")
    sources = docs.select(key.alias("source_key"), names.alias("source")).filter("source_key IS NOT NULL")
    return readers.resolve_sources(rows, sources).select("id", "source")


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS id, lang AS split, text AS question_final FROM documents
""")
def split_files(spark: SparkSession, folder: str) -> DataFrame:
    """Items written as JSON lines per split and read back with the split from the path."""
    path = new_table_path(spark, "splits")
    writers.write_partitions(items(spark, folder).select("id", "question_final", "split"), path, ["split"], "json")
    # One folder per split; the reader takes any of them, here all.
    rows = spark.read.schema("id STRING, question_final STRING, split STRING").option("mode", "FAILFAST").json(path)
    return rows.select("id", "split", "question_final")


@query("""
    SELECT lang AS split, CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'de' THEN 'reviewed' ELSE source END AS chapter FROM documents
""")
def replaced_split(spark: SparkSession, folder: str) -> DataFrame:
    """One split of a stored table replaced by its reviewed copy, with a backup."""
    path, backup = new_table_path(spark, "dataset"), new_table_path(spark, "backup")
    rows = items(spark, folder).select("id", "chapter", "split")
    writers.write_partitions(rows, path, ["split"])
    reviewed = rows.filter("split = 'de'").withColumn("chapter", F.lit("reviewed"))
    writers.replace_split(spark, path, reviewed, backup, "20260101T000000Z")
    return spark.read.schema("id STRING, chapter STRING, split STRING").parquet(path).select("split", "id", "chapter")


@query("""
    WITH reviewed AS (
      SELECT lang AS split, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS twice
      FROM documents WHERE lang <> 'es' GROUP BY lang)
    SELECT split, CASE WHEN split = 'fr' AND twice > 0 THEN 'failed' ELSE 'applied' END AS status,
           CASE WHEN split = 'fr' AND twice > 0 THEN twice || ' repeated ids' END AS reason,
           n + CASE WHEN split = 'fr' THEN twice ELSE 0 END AS rows FROM reviewed
    UNION ALL SELECT DISTINCT lang, 'skipped', 'no reviewed rows', 0 FROM documents WHERE lang = 'es'
    UNION ALL SELECT 'new', 'skipped', 'no stored rows', count(*) FROM labels
""")
def replacement_report(spark: SparkSession, folder: str) -> DataFrame:
    """Splits put in place of stored ones: one has repeated ids, one no review, one no base."""
    path, backup = new_table_path(spark, "dataset"), new_table_path(spark, "backup")
    rows = items(spark, folder).select("id", "chapter", "split")
    writers.write_partitions(rows, path, ["split"])
    toxic = table(spark, folder, "labels").filter("toxic = 1").select(text("doc_id").alias("id"))
    again = rows.filter("split = 'fr'").join(toxic, "id", "left_semi")
    new = table(spark, folder, "labels").select(text("doc_id").alias("id"), F.lit("c").alias("chapter"), F.lit("new").alias("split"))
    reviewed = rows.filter("split <> 'es'").unionByName(again).unionByName(new)
    wanted = reviewed.select("split").unionByName(rows.select("split"))
    report = writers.replace_split(spark, path, reviewed, backup, "20260101T000000Z", wanted=wanted)
    return report.select("split", "status", "reason", "rows")


@query("""
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS operation, count(*) AS calls FROM events
    WHERE strftime(ts, '%Y-%m-%d') IN (SELECT strftime(min(ts), '%Y-%m-%d') FROM events GROUP BY event_type)
    GROUP BY ALL
""")
def archived_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of the days on which some operation began, out of a log kept by day."""
    events = table(spark, folder, "events")
    path = new_table_path(spark, "calls")
    calls = schemas.complete(
        events.select(F.col("ts").cast("timestamp").alias("timestamp_utc"), F.col("event_type").alias("operation"), text("user_id").alias("run_id")),
        schemas.CALL_LOG,
    )
    day = F.to_date("timestamp_utc")
    writers.archive_calls(calls.withColumns({"date": day, "day": day}), path)
    first = events.groupBy("event_type").agg(F.min("ts").cast("date").alias("day"))
    archived = readers.read_archived_calls(spark, path, first)
    return archived.groupBy(text("day").alias("day"), "operation").agg(F.count("*").alias("calls"))


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN source = 'src3' THEN 'error' ELSE 'success' END AS status,
           CASE WHEN source <> 'src3' THEN 'Reply to ' || source || ' in ' || lang END AS response,
           CASE WHEN source = 'src3' THEN 'ValueError: no' END AS error
    FROM documents
""")
def ledger_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Replies by request, each distinct request called once and kept in a ledger for the next run."""
    def scorer() -> Callable[[str], str]:
        def call(request: str) -> str:
            if request.startswith("src3 "):
                raise ValueError("no")
            return f"Reply to {request}"

        return call

    ledger = new_table_path(spark, "ledger")
    asked = items(spark, folder).select("id", F.concat_ws(" in ", "chapter", "split").alias("request"))
    scoring.score_once(asked.filter("id LIKE '%7'"), "request", scorer, ledger, buckets=16)
    scored = scoring.score_once(asked, "request", scorer, ledger, buckets=16)
    return scored.select("id", "scored.status", "scored.response", "scored.error")


@query("""
    SELECT DISTINCT lang AS split FROM documents WHERE lang NOT IN (SELECT lang FROM documents WHERE n_chars > 20000)
""")
def missing_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Splits that still have to be produced."""
    docs = table(spark, folder, "documents").withColumnRenamed("lang", "split")
    return writers.missing_splits(docs, docs.filter("n_chars > 20000"))


@query(USAGE_SQL)
def stream_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Usage totals kept by a stream over the call log."""
    schema = table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    calls = call_log(events).withColumn("run_id", F.col("run_user"))
    path, checkpoint = new_table_path(spark, "totals"), new_table_path(spark, "checkpoint")
    totals.write_totals(calls, path, checkpoint).awaitTermination()
    return usage_totals.roll_usage(totals.latest_totals(spark, path))


@query("""
    SELECT CAST(o_custkey AS VARCHAR) AS id, max(o_orderkey) AS last_order FROM orders GROUP BY 1
""")
def stream_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Rows processed once per key as they arrive; of repeated keys the last counts."""
    schema = table(spark, folder, "orders").schema
    orders = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(folder)
    rows = orders.select(text("o_custkey").alias("id"), "o_orderkey")
    path, checkpoint = new_table_path(spark, "results"), new_table_path(spark, "checkpoint")
    incremental.process_new_rows(
        rows, lambda fresh: fresh.withColumnRenamed("o_orderkey", "last_order"), path, checkpoint,
        keys=["id"], order=["o_orderkey"],
    ).awaitTermination()
    return spark.read.parquet(path).select("id", "last_order")
