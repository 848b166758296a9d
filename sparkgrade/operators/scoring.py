"""Row scorer: apply a user's callable to a request column, in parallel.

The callable is the only thing the caller supplies (a model client, a rule, a stub).
Only the request text travels to Python; all other columns stay in the JVM. Results
carry status, error, attempts and latency, so dead letters and the call log are plain
projections. A NULL request is skipped, which is how a second pass touches only the rows
that need it. Scoring is not idempotent under recomputation: write the result
(:func:`sparkgrade.session.cut_lineage`) before using it twice, and leave speculation off,
or let :func:`score_once` keep a ledger of replies, so that no request is called twice.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions import text as tx
from sparkgrade.functions.text import as_column
from sparkgrade.session import cut_lineage, file_system, qualified

SCORED = (
    "response string, status string, error string, attempts int, latency_ms bigint, "
    "attempt_errors array<string>, attempt_latency_ms array<bigint>"
)
FIELDS = [part.split()[0] for part in SCORED.split(", ")]


def _attempt(
    call: Callable[[str], str], request: str | None, max_attempts: int, accept: Callable[[str], bool] | None = None
) -> tuple:
    if request is None:
        return None, "skipped", None, 0, 0, [], []
    errors, spent, response = [], [], None
    for _ in range(max(1, max_attempts)):
        started = time.monotonic()
        try:
            response, error = call(request), None
            if accept is not None and not accept(response):
                error = "unusable reply"
        except Exception as problem:  # a failing row must not fail its task
            response, error = None, f"{type(problem).__name__}: {problem}"
        spent.append(int((time.monotonic() - started) * 1000))
        errors.append(error)
        if error is None:
            return response, "success", None, len(errors), sum(spent), errors, spent
    return response, "error", errors[-1], len(errors), sum(spent), errors, spent


def score(
    request: Column | str, setup: Callable[[], Callable[[str], str]], max_attempts: int = 1, threads: int = 1,
    accept: Callable[[str], bool] | None = None,
) -> Column:
    """Struct column ``SCORED`` from one call per row.

    ``setup`` runs once per task and returns the callable (open a client there);
    ``threads`` overlaps waiting calls inside a task. A reply that ``accept`` refuses is a
    failed attempt; the last such reply stays in ``response`` beside the error.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = setup()
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                results = pool.map(lambda r: _attempt(call, r, max_attempts, accept), batch)
                yield pd.DataFrame(list(results), columns=FIELDS)

    # The evaluated hints name the iterator form of a pandas UDF.
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, SCORED).asNondeterministic()(as_column(request))


def score_batches(
    request: Column | str, setup: Callable[[], Callable[[list[str]], list[str]]], batch_size: int = 64
) -> Column:
    """As :func:`score` for a callable that answers a list of requests at once.

    A batch that raises, or answers with the wrong number of texts, marks its rows as
    failed; other batches go on.
    """
    def one_batch(call: Callable, requests: list[str]) -> list[tuple]:
        started = time.monotonic()
        try:
            responses, error = call(requests), None
            if len(responses) != len(requests):
                error = f"{len(responses)} responses for {len(requests)} requests"
        except Exception as problem:
            error = f"{type(problem).__name__}: {problem}"
        spent = int((time.monotonic() - started) * 1000)
        if error is not None:
            return [(None, "error", error, 1, spent, [error], [spent])] * len(requests)
        return [(r, "success", None, 1, spent, [None], [spent]) for r in responses]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = setup()
        for batch in batches:
            out = [_attempt(call, None, 1)] * len(batch)
            wanted = [i for i, r in enumerate(batch) if r is not None]
            for start in range(0, len(wanted), batch_size):
                chosen = wanted[start:start + batch_size]
                for i, result in zip(chosen, one_batch(call, [batch.iloc[i] for i in chosen])):
                    out[i] = result
            yield pd.DataFrame(out, columns=FIELDS)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, SCORED).asNondeterministic()(as_column(request))


def score_once(
    df: DataFrame, request: Column | str, setup: Callable[[], Callable[[str], str]], ledger: str, max_attempts: int = 1,
    threads: int = 1, accept: Callable[[str], bool] | None = None, buckets: int = 256, flush: int = 16, column: str = "scored",
) -> DataFrame:
    """``df`` with the struct column of :func:`score`, each distinct request called once.

    Replies are kept in the folder ``ledger``, keyed by the request's SHA-256 and bucketed by it.
    A task appends them as it goes, ``flush`` at a time, each file under a name of its own
    and renamed when it is whole; it first reads what its buckets hold. So a task that is
    tried again, or a later run, calls only what has no successful reply yet: at most
    ``flush`` calls are repeated after an executor is lost, none after an exception. Failed
    requests are called again by the next try. One task at a time holds one bucket's replies.
    """
    spark = df.sparkSession
    folder = qualified(spark, ledger)
    keyed = df.withColumn("_request", as_column(request)).withColumn("_key", F.sha2("_request", 256))
    keyed = cut_lineage(keyed, "requests")
    bucket = F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int").alias("bucket")
    asked = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.min("_request").alias("_request")).select(bucket, "_key", "_request")
    asked = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, at, known = setup(), None, {}
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                rows = list(zip(*(batch[c].to_pylist() for c in ("bucket", "_key", "_request"))))
                for part, group in groupby(rows, key=lambda r: r[0]):
                    if part != at:
                        at, known = part, read_ledger(folder, part)
                    group = list(group)
                    yield from _answered([r for r in group if r[1] in known], [known[r[1]] for r in group if r[1] in known])
                    todo = [r for r in group if r[1] not in known]
                    for chosen in (todo[i:i + flush] for i in range(0, len(todo), flush)):
                        calls = [pool.submit(_attempt, call, r[2], max_attempts, accept) for r in chosen]
                        wait(calls)
                        done = [(r, c.result()) for r, c in zip(chosen, calls) if c.exception() is None]
                        append_ledger(folder, part, [(r[1], result) for r, result in done if result[1] == "success"])
                        for c in calls:
                            c.result()
                        yield from _answered([r for r, _ in done], [result for _, result in done])

    answers = cut_lineage(asked.mapInArrow(run, f"_key string, {SCORED}"), "replies")
    struct = F.struct(*FIELDS).alias(column)
    joined = keyed.join(answers.select("_key", struct), "_key", "left").drop("_key", "_request")
    none = F.lit(None).cast("string")
    skipped = F.struct(
        none.alias("response"), F.lit("skipped").alias("status"), none.alias("error"), F.lit(0).alias("attempts"),
        F.lit(0).cast("bigint").alias("latency_ms"), F.array().cast("array<string>").alias("attempt_errors"),
        F.array().cast("array<bigint>").alias("attempt_latency_ms"),
    )
    return joined.withColumn(column, F.coalesce(column, skipped))


ANSWER = pa.schema([
    ("_key", pa.string()), ("response", pa.string()), ("status", pa.string()), ("error", pa.string()), ("attempts", pa.int32()),
    ("latency_ms", pa.int64()), ("attempt_errors", pa.list_(pa.string())), ("attempt_latency_ms", pa.list_(pa.int64())),
])


def _answers(keys: list[str], results: list[tuple]) -> pa.Table:
    columns = [keys, *zip(*results)]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, ANSWER)], schema=ANSWER)


def _answered(rows: list[tuple], results: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield from _answers([r[1] for r in rows], results).to_batches()


def read_ledger(folder: str, bucket: int) -> dict[str, tuple]:
    """Key to result of all whole files of one bucket."""
    system, base = file_system(f"{folder}/bucket={bucket}")
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    known = {}
    for file in found:
        if file.base_name.endswith(".parquet"):
            with system.open_input_file(file.path) as source:
                rows = pq.read_table(source).to_pydict()
            known.update(zip(rows["_key"], zip(*(rows[f] for f in FIELDS))))
    return known


def append_ledger(folder: str, bucket: int, results: list[tuple[str, tuple]]) -> None:
    """Add results to a bucket as one file that appears whole or not at all."""
    if not results:
        return
    system, base = file_system(f"{folder}/bucket={bucket}")
    system.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    with system.open_output_stream(f"{base}/{name}.part") as sink:
        pq.write_table(_answers([k for k, _ in results], [r for _, r in results]), sink)
    system.move(f"{base}/{name}.part", f"{base}/{name}.parquet")


def spread(df: DataFrame, tasks: int | None) -> DataFrame:
    """Even out rows over tasks before scoring, so one file or split is not one task's work."""
    return df if tasks is None else df.repartition(tasks)


def succeeded(scored: DataFrame, column: str = "scored") -> DataFrame:
    return scored.filter(F.col(f"{column}.status") == "success")


def dead_letters(scored: DataFrame, keys: list[str], column: str = "scored") -> DataFrame:
    """Rows that failed for good, with their error."""
    return scored.filter(F.col(f"{column}.status") == "error").select(
        *keys, F.col(f"{column}.error").alias("error"), F.col(f"{column}.attempts").alias("attempts")
    )


def call_log(scored: DataFrame, keys: list[str], column: str = "scored") -> DataFrame:
    """One row per attempt: number, status, error, latency."""
    attempts = F.arrays_zip(f"{column}.attempt_errors", f"{column}.attempt_latency_ms")
    rows = scored.select(*keys, F.posexplode(attempts).alias("_at", "_try"))
    return rows.select(
        *keys,
        (F.col("_at") + 1).alias("attempt"),
        F.when(F.col("_try.attempt_errors").isNull(), "success").otherwise("error").alias("status"),
        F.col("_try.attempt_errors").alias("error_message"),
        F.col("_try.attempt_latency_ms").alias("latency_ms"),
    )


def reply_json(reply: Column | str, fields: str) -> Column:
    """Struct from a JSON reply, code fences removed; NULL when it is unusable."""
    return F.from_json(tx.strip_code_fence(reply), fields)


def reply_object(reply: str | None) -> dict | None:
    """The JSON object of a reply, code fences removed; None when there is none."""
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", reply or "")
    try:
        found = json.loads(body)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def is_object(reply: str | None) -> bool:
    return reply_object(reply) is not None
