import json

import pytest
from pyspark.sql import functions as F

from sparkgrade import schemas
from sparkgrade.operators import merge, scoring, usage_totals
from sparkgrade.plans import build, evaluate, generate, reports
from sparkgrade.session import cut_lineage, shared_folder
from sparkgrade.sources import readers, writers
from sparkgrade.streaming import incremental, totals


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def dataset(spark, *ids):
    data = [("s", i, "x + 1", "sympy", 1) for i in ids]
    return spark.createDataFrame(data, "split string, id string, reference_answer string, answer_kind string, _pos int")


def answers(spark, **given):
    return spark.createDataFrame(
        [("s", i, a, n) for n, (i, a) in enumerate(given.items())], "split string, id string, final_answer_for_compare string, _pos int"
    )


def test_rule_evaluation_is_incremental(spark):
    items = dataset(spark, "a", "b", "c")
    first = evaluate.rule_evaluation(items, answers(spark, a="1+x", b="x"), "m", pos="_pos")
    assert rows_of(first.rows, "id", "is_correct", "detail") == [
        ("a", True, "sympy_equal"), ("b", False, "sympy_not_equal"), ("c", False, "missing_prediction"),
    ]
    total = first.summary.filter("level = 'overall'").collect()[0]
    assert (total.total, total.correct, total.earned_points) == (3, 1, 1.0)

    # "c" leaves the dataset, "d" arrives: old results stay, stale ones go, only "d" is graded.
    later = evaluate.rule_evaluation(
        dataset(spark, "a", "b", "d"), answers(spark, a="wrong", d="x+1"), "m", existing=first.rows, pos="_pos"
    )
    assert rows_of(later.rows, "id", "is_correct") == [("a", True), ("b", False), ("d", True)]

    # Named ids are graded again; with missing answers excluded they may disappear.
    ids = spark.createDataFrame([("b",), ("d",)], "id string")
    named = evaluate.rule_evaluation(
        dataset(spark, "a", "b", "d"), answers(spark, b="x+1"), "m", existing=later.rows, ids=ids, include_missing=False, pos="_pos"
    )
    assert rows_of(named.rows, "id", "is_correct") == [("a", True), ("b", True)]


def test_grading_keeps_false_references(spark):
    items = spark.createDataFrame([("s", "1", "False", "bool")], "split string, id string, reference_answer string, answer_kind string")
    got = evaluate.rule_evaluation(items, answers(spark, **{"1": "no"}), "m").rows.collect()[0]
    assert got.is_correct and got.reference == "False" and got.detail == "exact_equal"


def test_judge_evaluation(spark):
    def judge():
        return lambda request: json.dumps({"is_correct": "x + 1" in request, "reasoning_correct": "yes", "judge_reason": "Fine. Really."})

    got = evaluate.judge_evaluation(dataset(spark, "a", "b"), answers(spark, a="x"), "m", "j", judge, pos="_pos")
    assert rows_of(got.rows, "id", "answer_correct", "detail", "judge_reason") == [
        ("a", True, "ok", "Fine."), ("b", False, "both_wrong", "Prediction missing."),
    ]


def test_reports_run(spark):
    items = spark.createDataFrame([("s", str(i), "equilibrium price " * (i + 1), "value") for i in range(9)], "split string, id string, q string, question_type string")
    evals = spark.createDataFrame([("m", "s", str(i), i % 2 == 0, "d") for i in range(9)], "model string, split string, id string, is_correct boolean, detail string")
    lengths = reports.length_report(items, evals.drop("split"), "q")
    assert lengths.breakdown.count() == 3 and lengths.bins.count() == 3
    fixed = reports.length_report(items, evals.drop("split"), "q", short_max=2, medium_max=5)
    assert rows_of(fixed.bins, "length_bin", "n") == [("Long", 7), ("Medium", 1), ("Short", 1)]
    words = reports.keyword_report(items, evals, "q")
    assert rows_of(words.top, "model", "keyword", "wrong_question_count", "lift") == [("m", "equilibrium", 4, 1.0)]
    assert words.links.count() == 4


def test_generation_resumes(spark):
    items = dataset(spark, "a", "b", "c").withColumns({
        "question_final": F.concat(F.lit("Q "), "id"), "reference_answer_sympy": F.lit("x + 1"),
    })

    def solver():
        def call(request):
            if "Q c" in request:
                raise RuntimeError("down")
            return "so \\boxed{f(2)+x}"

        return call

    done = spark.createDataFrame([("s", "a")], "split string, id string")
    got = generate.generate(items, "m", solver, done=done, max_attempts=2)
    assert rows_of(got.rows, "id", "final_answer_for_compare", "mismatch_symbols") == [("b", "f_n_2+x", ["f_n_2"])]
    assert rows_of(got.failures, "id", "attempts") == [("c", 2)]
    assert rows_of(got.calls, "id", "attempt", "status") == [("b", 1, "success"), ("c", 1, "error"), ("c", 2, "error")]
    converted = generate.generate(items, "m", solver, converter=lambda: lambda r: "`y`", ids=done.select("id"))
    assert rows_of(converted.rows, "id", "answer_sympy") == [("a", "y")]


def test_batch_scorer_marks_only_the_bad_batch(spark):
    def batch():
        def call(requests):
            if "3" in requests:
                raise ValueError("no")
            return requests[1:] if "6" in requests else [r * 2 for r in requests]

        return call

    df = spark.range(9).coalesce(1).select(F.when(F.col("id") != 8, F.col("id").cast("string")).alias("r"))
    got = df.select(scoring.score_batches("r", batch, 2).alias("s")).select("s.response", "s.status").collect()
    assert [tuple(r) for r in got] == [
        ("00", "success"), ("11", "success"), (None, "error"), (None, "error"), ("44", "success"), ("55", "success"),
        (None, "error"), (None, "error"), (None, "skipped"),
    ]


def test_cached_stage_rows_are_reused(spark):
    problems = spark.createDataFrame([("s", "1", "q", "r"), ("s", "2", "q", "r")], "split string, id string, question_original string, reference_answer_original string")
    first = build.check_references(problems, lambda: lambda r: '{"final_reference_answer": "one"}')
    again = build.check_references(
        problems, lambda: lambda r: '{"final_reference_answer": "two"}', cache=first.filter("id = '1'")
    )
    assert rows_of(again, "id", "reference_answer_corrected", "reference_is_correct") == [("1", "one", False), ("2", "two", False)]


def test_jsonl_reader_keeps_order_and_tolerates_absence(spark, tmp_path):
    lines = ['{"id": "a", "n": 1}', "", '{"id": "b", "n": 2}', '{"id": "a", "n": 3}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id STRING, n INT")
    assert rows_of(readers.latest_by_id(rows), "id", "n") == [("a", 3), ("b", 2)]
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "id STRING, n INT").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"id": ')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id STRING, n INT").collect()


def test_split_reader(spark, tmp_path):
    for name in ("chapter_1", "chapter_2", "chapter_2_balanced"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"id": name, "split": "ignored"}))
    (tmp_path / "notes.txt").write_text("no")
    assert rows_of(readers.read_splits(spark, str(tmp_path), "id STRING, split STRING"), "split", "id") == [
        ("chapter_1", "chapter_1"), ("chapter_2", "chapter_2"),
    ]
    named = readers.read_splits(spark, str(tmp_path), "id STRING", "chapter_2_balanced")
    assert rows_of(named, "split") == [("chapter_2_balanced",)]


def test_source_tree(spark, tmp_path):
    chapter = tmp_path / "part" / "6"
    (chapter / "out_split" / "6.1").mkdir(parents=True)
    (chapter / "by_problem").mkdir()
    (chapter / "out_split" / "6.1" / "i.json").write_text(json.dumps({"problem": {"problem_latex": "Q", "source_file": "x.json"}}))
    (chapter / "out_split" / "6.1" / "main.json").write_text(json.dumps({"problem_latex": "M", "subquestion_path": ["a", "b"], "number": 7}))
    (chapter / "by_problem" / "6.1.json").write_text(json.dumps({"problem_latex": "P", "answer_latex": "A"}))
    from sparkgrade.operators.build import problem_rows

    rows = problem_rows(readers.read_problem_files(spark, str(tmp_path)), readers.read_parent_files(spark, str(tmp_path)))
    assert rows_of(rows, "id", "split", "question_original", "source_problem_latex", "reference_answer_original") == [
        ("6.1/i", "chapter_part_6", "Q", "P", "A"), ("7/a.b", "chapter_part_6", "M", "", "N/A"),
    ]


def test_review_and_log_readers(spark, tmp_path):
    for name, text in [("ann", '{"entries": {"1": {"annotation": {"answer": "x"}}}}'), ("bob", "{broken")]:
        (tmp_path / name).mkdir()
        (tmp_path / name / "s.json").write_text(text)
    got = readers.read_reviews(spark, str(tmp_path)).collect()
    assert [(r.split, r.id, r.annotator, r.annotator_rewritten_answer) for r in got] == [("s", "1", "ann", '{"answer": "x"}')]
    (tmp_path / "logs" / "2026-01-02").mkdir(parents=True)
    (tmp_path / "logs" / "2026-01-02" / "r.jsonl").write_text('{"timestamp_utc": "2026-01-02T03:04:05Z", "run_id": "r"}')
    log = readers.read_call_log(spark, str(tmp_path / "logs")).collect()
    assert [(r.run_id, str(r.date)) for r in log] == [("r", "2026-01-02")]


def test_writers(spark, tmp_path):
    table, backup = str(tmp_path / "t"), str(tmp_path / "b")
    rows = spark.createDataFrame([("m", "a", 1), ("m", "b", 2)], "model string, split string, v int")
    writers.write_partitions(rows, table, ["model", "split"])
    writers.write_partitions(rows.filter("split = 'a'").withColumn("v", F.lit(9)), table, ["model", "split"])
    assert rows_of(spark.read.parquet(table), "split", "v") == [("a", 9), ("b", 2)]
    writers.clone_artifact(spark, table, "m", "n")
    assert rows_of(spark.read.parquet(table), "model", "v") == [("m", 2), ("m", 9), ("n", 2), ("n", 9)]
    for source, target in [("m", "m"), ("m", "n"), ("none", "x")]:
        with pytest.raises(ValueError):
            writers.clone_artifact(spark, table, source, target)
    reviewed = spark.createDataFrame([("m", "b", 5), ("m", "z", 6)], "model string, split string, v int")
    plain = str(tmp_path / "plain")
    writers.write_partitions(rows, plain, ["split"])
    report = writers.replace_split(spark, plain, reviewed, backup, "t0")
    assert rows_of(report, "split", "status") == [("b", "applied"), ("z", "skipped")]
    assert rows_of(spark.read.parquet(plain), "split", "v") == [("a", 1), ("b", 5)]
    assert rows_of(spark.read.parquet(backup), "backup", "split", "v") == [("t0", "b", 2)]
    writers.write_csv(rows, str(tmp_path / "c"), ["v", "split"])
    assert rows_of(spark.read.option("header", True).csv(str(tmp_path / "c")), "v", "split") == [("1", "a"), ("2", "b")]
    writers.write_ids(rows, str(tmp_path / "i"), "split")
    assert rows_of(spark.read.text(str(tmp_path / "i")), "value") == [("a",), ("b",)]
    writers.write_stage_bundle({"stage1": rows, "final": rows}, str(tmp_path / "bundle"))
    assert spark.read.parquet(str(tmp_path / "bundle" / "final")).count() == 2


def test_pending_and_done_cover_the_dataset(spark):
    items, done = dataset(spark, "a", "b", "c"), dataset(spark, "b", "x")
    pending = merge.pending_rows(items, done)
    assert rows_of(pending, "id") == [("a",), ("c",)]
    assert rows_of(merge.stale_rows(done, items), "id") == [("x",)]


def test_stream_totals_equal_batch_totals(spark, tmp_path):
    calls = [("r1", "m", "op", "success", 5, 1), ("r1", "m", "op2", "error", None, 2), ("r2", " ", "op", "success", 7, 3)]
    ddl = "run_id string, model_requested string, operation string, status string, usage_input_tokens bigint, usage_output_tokens bigint"
    df = spark.createDataFrame(calls, ddl)
    for c in ("usage_cache_creation_tokens", "usage_cache_read_tokens"):
        df = df.withColumn(c, F.lit(0).cast("bigint"))
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    for i in range(2):
        df.write.mode("append").parquet(log)
        stream = spark.readStream.schema(df.schema).parquet(log)
        totals.write_totals(stream, out, state).awaitTermination()
    batch = usage_totals.usage_totals(spark.read.parquet(log))
    streamed = usage_totals.roll_usage(totals.latest_totals(spark, out))
    assert rows_of(streamed, *batch.columns) == rows_of(batch, *batch.columns)


def test_stream_processes_each_key_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    ddl = "split string, id string, v int"
    for batch in ([("s", "a", 1), ("s", "a", 2)], [("s", "a", 3), ("s", "b", 4)]):
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.struct(ddl)).parquet(source)
        incremental.process_new_rows(stream, lambda df: df, out, state, order=["v"]).awaitTermination()
    assert rows_of(spark.read.parquet(out), "id", "v") == [("a", 2), ("b", 4)]


def test_lineage_is_cut_in_the_shared_folder(spark):
    df = cut_lineage(spark.range(3).withColumn("x", F.col("id") * 2), "probe")
    assert df.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(shared_folder(spark).lstrip("/"))
    assert rows_of(df, "x") == [(0,), (2,), (4,)]


def test_last_rows_count_without_naming_their_order(spark):
    items = dataset(spark, "a")
    twice = spark.createDataFrame([("s", "a", "x", 1), ("s", "a", "1+x", 2)], "split string, id string, final_answer_for_compare string, _pos int")
    got = evaluate.rule_evaluation(items, twice, "m")
    assert rows_of(got.rows, "id", "is_correct") == [("a", True)]
    with pytest.raises(ValueError, match="duplicate"):
        evaluate.rule_evaluation(items, twice.drop("_pos"), "m")


def test_refused_replies_are_asked_again(spark):
    def scorer():
        asked = []

        def call(request):
            asked.append(request)
            return "{}" if asked.count(request) == int(request) else "no"

        return call

    rows = spark.createDataFrame([("1",), ("3",), ("9",)], "id string").coalesce(1)
    got = cut_lineage(rows.withColumn("s", scoring.score("id", scorer, 3, accept=scoring.is_object)))
    assert rows_of(got, "id", "s.status", "s.attempts", "s.response") == [
        ("1", "success", 1, "{}"), ("3", "success", 3, "{}"), ("9", "error", 3, "no"),
    ]
