"""Layers, call logs, replaced splits, ledgers, streams that resume."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkgrade import schemas
from sparkgrade.operators import keys, scoring, usage_totals
from sparkgrade.plans import generate
from sparkgrade.session import file_system, qualified
from sparkgrade.sources import readers, writers
from sparkgrade.streaming import incremental, totals


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_layers_with_one_heavy_owner(spark):
    """One owner holds half of all rows; NULL is an owner like any other."""
    owner = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") < 50, None).otherwise(F.col("id").cast("string"))
    rows = spark.range(20_000).select(owner.alias("model"), F.lit("s").alias("split"), (F.col("id") % 7).alias("layer"), "id").repartition(4)
    layers = [rows.filter(F.col("layer") == i) for i in range(7)]
    got = readers.layered(layers)
    held = rows.collect()
    first = {}
    for r in held:
        first[r.model] = min(first.get(r.model, 9), r.layer)
    assert rows_of(got, "id") == sorted((r.id,) for r in held if first[r.model] == r.layer)
    assert "map_from_entries" not in plan_of(got)
    # What is shuffled are the light owners' rows: no task has more than twice the median.
    winners = rows.groupBy(F.col("model").alias("_model")).agg(F.count("*").alias("n"))
    light = rows.join(winners.filter("n <= 20"), F.col("model").eqNullSafe(F.col("_model")), "left_semi")
    sizes = sorted(r["count"] for r in light.repartition(16, "model").groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_layers_of_nothing(spark):
    none = spark.createDataFrame([], "model string, split string, v int")
    assert readers.layered([none, none]).count() == 0


def test_log_of_named_days_and_runs_opens_only_these(spark, tmp_path):
    for day in ("2026-01-01", "2026-01-02", "2026-01-03"):
        (tmp_path / day).mkdir()
        for run in ("r1", "r2"):
            (tmp_path / day / f"{run}.jsonl").write_text(json.dumps({"timestamp_utc": f"{day}T03:04:05Z", "run_id": run}))
    (tmp_path / "2026-01-03" / "r1.jsonl").write_text('{"broken')
    log = readers.read_call_log(spark, str(tmp_path), days=["2026-01-02", "2027-01-01"])
    assert rows_of(log, "run_id", F.col("day").cast("string")) == [("r1", "2026-01-02"), ("r2", "2026-01-02")]
    assert all("2026-01-02" in f for f in log.inputFiles()) and len(log.inputFiles()) == 2
    one = readers.read_call_log(spark, str(tmp_path), days=["2026-01-01"], runs=["r2"])
    assert len(one.inputFiles()) == 1 and rows_of(one, "run_id") == [("r2",)]
    assert readers.read_call_log(spark, str(tmp_path), days=["1999-01-01"]).count() == 0
    assert readers.read_call_log(spark, str(tmp_path / "none")).count() == 0


def test_archived_log_is_pruned_by_day(spark, tmp_path):
    path = str(tmp_path / "calls")
    rows = spark.range(300).select(
        F.date_add(F.lit("2026-01-01"), (F.col("id") % 30).cast("int")).alias("day"), F.concat(F.lit("r"), F.col("id") % 3).alias("run_id"))
    calls = schemas.complete(rows, schemas.CALL_LOG).withColumn("date", F.col("day"))
    writers.archive_calls(calls, path)
    writers.archive_calls(calls.filter("day = '2026-01-05'").limit(1), path)
    days = spark.createDataFrame([("2026-01-05",), ("2026-01-06",)], "d string").filter("d > '2026-01-01'").select(F.to_date("d").alias("day"))
    found = readers.read_archived_calls(spark, path, days)
    assert rows_of(found.groupBy(F.col("day").cast("string").alias("day")).count(), "day", "count") == [("2026-01-05", 1), ("2026-01-06", 10)]
    assert "dynamicpruning" in plan_of(found)
    named = readers.read_archived_calls(spark, path).filter("day = '2026-01-06'")
    assert named.count() == 10 and "PartitionFilters: [isnotnull(day" in plan_of(named)


def test_failed_replacements_leave_their_split_alone(spark, tmp_path):
    table, backup = str(tmp_path / "t"), str(tmp_path / "b")
    rows = spark.createDataFrame([(s, str(i), 0) for s in "abcd" for i in range(5)], "split string, id string, v int")
    writers.write_partitions(rows, table, ["split"])
    reviewed = [("a", str(i), 1) for i in range(4)] + [("b", "1", 1), ("b", "1", 2)] + [("c", " ", 1), ("c", "2", 1), ("z", "1", 1)]
    reviewed = spark.createDataFrame(reviewed, "split string, id string, v int")
    report = writers.replace_split(spark, table, reviewed, backup, "t0", wanted=spark.createDataFrame([(s,) for s in "abcdz"], "split string"))
    assert rows_of(report, "split", "status", F.coalesce("reason", F.lit("")), "rows") == [
        ("a", "applied", "", 4), ("b", "failed", "1 repeated ids", 2), ("c", "failed", "1 blank ids", 2),
        ("d", "skipped", "no reviewed rows", 0), ("z", "skipped", "no stored rows", 1),
    ]
    assert rows_of(spark.read.parquet(table).groupBy("split").agg(F.sum("v").alias("v"), F.count("*").alias("n")), "split", "v", "n") == [
        ("a", 4, 4), ("b", 0, 5), ("c", 0, 5), ("d", 0, 5)]
    assert rows_of(spark.read.parquet(backup).groupBy("split").count(), "split", "count") == [("a", 5)]


def counting_scorer(log, poison=None):
    """Notes every call; the first time that ``poison`` is asked for ends the whole task."""
    def scorer():
        def call(request):
            if request == poison and not os.path.exists(log + ".tried"):
                open(log + ".tried", "w").close()
                raise SystemExit
            with open(log, "a") as file:
                file.write(request + "\n")
            if request == "r3":
                raise ValueError("no")
            return request.upper()

        return call

    return scorer


def test_ledger_calls_each_request_once(spark, tmp_path):
    log, ledger = str(tmp_path / "calls"), str(tmp_path / "ledger")
    df = spark.range(60).select("id", F.concat(F.lit("r"), F.col("id") % 20).alias("request")).repartition(3)
    df = df.unionByName(spark.createDataFrame([(99, None)], "id long, request string"))
    with pytest.raises(Exception):
        scoring.score_once(df, "request", counting_scorer(log, "r7"), ledger, buckets=2, flush=3, threads=2)
    called = open(log).read().split()
    assert 0 < len(called) < 20
    got = scoring.score_once(df, "request", counting_scorer(log, "r7"), ledger, buckets=2, flush=3, threads=2)
    done = [r for r in open(log).read().split() if r != "r3"]
    assert sorted(done) == sorted(f"r{i}" for i in range(20) if i != 3)
    want = [(i, "error" if i % 20 == 3 else "success", None if i % 20 == 3 else f"R{i % 20}") for i in range(60)] + [(99, "skipped", None)]
    assert sorted(map(str, rows_of(got, "id", "scored.status", F.coalesce("scored.response", F.lit(""))))) == sorted(
        str((i, s, r or "")) for i, s, r in want)
    # A later run asks for nothing but the failed request.
    again = scoring.score_once(df, "request", counting_scorer(log), ledger, buckets=2)
    assert again.filter("scored.status = 'success'").count() == 57
    assert len([r for r in open(log).read().split() if r != "r3"]) == 19
    assert len(scoring.dead_letters(again, ["id"]).collect()) == 3


def test_generation_with_a_ledger(spark, tmp_path):
    log, ledger = str(tmp_path / "calls"), str(tmp_path / "ledger")

    def solver():
        def call(request):
            with open(log, "a") as file:
                file.write("call\n")
            return "so \\boxed{x}"

        return call

    data = [("s", i, "Q " + i, "x", "sympy") for i in ("a", "b")]
    items = spark.createDataFrame(data, "split string, id string, question_final string, reference_answer_sympy string, answer_kind string")
    for _ in range(2):
        got = generate.generate(items, "m", solver, ledger=ledger)
        assert rows_of(got.rows, "id", "final_answer_for_compare") == [("a", "x"), ("b", "x")]
    assert open(log).read().count("call") == 2


def test_paths_are_qualified(spark, tmp_path):
    path = qualified(spark, str(tmp_path))
    assert path.startswith("file:") and file_system(path)[1] == str(tmp_path)


def stream_of(spark, path, ddl):
    return spark.readStream.schema(schemas.struct(ddl)).parquet(path)


@pytest.mark.parametrize("order", [["v"], []])
def test_resumed_stream_reads_new_rows_only(spark, tmp_path, order, monkeypatch):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    ddl = "split string, id string, v int"
    batches = [[("s", "a", 1), ("s", "a", 2), (None, "n", 1)], [("s", "a", 3), ("s", "b", 4), (None, "n", 2)], [("s", "b", 9)]]
    read = []
    monkeypatch.setattr(type(spark.read), "parquet", lambda *a, **k: pytest.fail("a batch reads stored rows"))
    for batch in batches:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(source)
        query = incremental.process_new_rows(stream_of(spark, source, ddl), lambda df: df, out, state, order=order)
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
    monkeypatch.undo()
    assert read == [3, 3, 1]
    got = spark.read.parquet(out)
    assert rows_of(got, F.coalesce("split", F.lit("")), "id") == [("", "n"), ("s", "a"), ("s", "b")]
    if order:
        assert rows_of(got, "id", "v") == [("a", 2), ("b", 4), ("n", 1)]


def test_replayed_batch_adds_nothing(spark, tmp_path):
    """A batch whose result was not stored is run again and chooses the same rows."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    ddl = "split string, id string, v int"
    tries = []

    def process(df):
        tries.append(1)
        if len(tries) == 2:
            df.write.mode("overwrite").parquet(f"{out}/batch=1")
            raise RuntimeError("lost")
        return df

    for batch in ([("s", "a", 1), ("s", "b", 1)], [("s", "a", 5), ("s", "c", 1), ("s", "c", 2)]):
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(source)
        run = lambda: incremental.process_new_rows(stream_of(spark, source, ddl), process, out, state, order=["v"])
        if len(tries) == 1:
            with pytest.raises(Exception):
                run().awaitTermination()
        run().awaitTermination()
    assert len(tries) == 3
    assert rows_of(spark.read.parquet(out), "id", "v") == [("a", 1), ("b", 1), ("c", 2)]


CALLS = "run_id string, model_requested string, operation string, status string, usage_input_tokens bigint, usage_output_tokens bigint, usage_cache_creation_tokens bigint, usage_cache_read_tokens bigint"


def test_stored_totals_are_one_row_a_combination(spark, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))

    def files():
        return {(d, f) for d in os.listdir(out) if d.startswith("bucket=") for f in os.listdir(f"{out}/{d}") if f.endswith(".parquet")}

    for n in range(3):
        calls = [(f"r{i}" if i else None, "m", "op", "success", 1, 2, 0, 0) for i in range(40 if n == 0 else 2)]
        spark.createDataFrame(calls, CALLS).coalesce(1).write.mode("append").parquet(log)
        before = files() if n else set()
        totals.write_totals(stream_of(spark, log, CALLS), out, state, buckets=8).awaitTermination()
        stored = spark.read.parquet(out)
        assert stored.count() == 40 and stored.select("run_id").distinct().count() == 40
        if n:
            assert len({d for d, f in before - files()}) <= 2 < len({d for d, _ in files()})
    batch = usage_totals.usage_totals(spark.read.parquet(log))
    streamed = usage_totals.roll_usage(totals.latest_totals(spark, out))
    assert sorted(map(str, streamed.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
    totals.store_totals(totals.latest_totals(spark, out).limit(5), out, ["run_id"], 8)
    assert sorted(map(str, usage_totals.roll_usage(totals.latest_totals(spark, out)).select(*batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_small_samples_take_one_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(5000).write.parquet(path)
    df = spark.read.parquet(path)
    small, whole = keys.sample_rows(df, 100, 42, ["id"]), keys.sample_rows(df, F.lit(100), 42, ["id"])
    assert rows_of(small, "id") == rows_of(whole, "id") and small.count() == 100
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "TakeOrderedAndProject" in plan
