import random

import pytest
from pyspark.sql import functions as F

from sparkgrade.operators import (
    categories, compare, confirm, grading, keys, keywords, lengths, merge, overlay, rebalance, rerun, summary,
)
from sparkgrade.sources.readers import layered, scored_models


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_last_per_key_does_not_depend_on_partitions(spark, partitions):
    data = [("hot", i, f"v{i}") for i in range(200)] + [("cold", 1, "only")]
    random.Random(partitions).shuffle(data)
    df = spark.createDataFrame(data, "id string, pos int, v string").repartition(partitions)
    assert rows_of(keys.last_per_key(df, ["id"], ["pos"]), "id", "v") == [("cold", "only"), ("hot", "v199")]
    assert rows_of(keys.first_per_key(df, ["id"], ["pos"]), "id", "v") == [("cold", "only"), ("hot", "v0")]


def test_window_trims_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1)], "id string, pos int").repartition(2)
    plan = keys.last_per_key(df, ["id"], ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_require_unique(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    with pytest.raises(ValueError, match="a"):
        keys.require_unique(df, ["id"])
    assert keys.require_unique(df.distinct(), ["id"]).count() == 2


def test_global_rank(spark):
    values = random.Random(1).sample(range(10_000), 997)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = {r.v: r.rank for r in keys.global_rank(df, ["v"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values), start=1)}


@pytest.mark.parametrize("n", [0, 1, 37, 500, 900])
def test_sample_is_exact_and_stable(spark, n):
    df = spark.range(500)
    first = rows_of(keys.sample_rows(df, n, 42, ["id"]), "id")
    again = rows_of(keys.sample_rows(df.repartition(9), n, 42, ["id"]), "id")
    assert first == again and len(set(first)) == min(n, 500)


def test_id_filter_none_keeps_all_and_empty_keeps_none(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    (tmp_path / "empty.txt").write_text(" \n")
    assert keys.keep_ids(df, keys.id_list(spark)).count() == 2
    assert keys.keep_ids(df, keys.id_list(spark, "")).count() == 2
    assert keys.keep_ids(df, keys.id_list(spark, path=str(tmp_path / "empty.txt"))).count() == 0
    assert rows_of(keys.keep_ids(df, keys.id_list(spark, "b, c\nb")), "id") == [("b",)]


def test_match_problems(spark):
    df = spark.createDataFrame([("1.2/i", "1.2"), ("1.2/ii#1", "1.2"), ("1.20/i", "1.20"), ("9/x", "7")], "id string, problem_number string")
    chosen = spark.createDataFrame([(" 1.2 ",), ("7",), ("1.20/i",)], "selector string")
    assert rows_of(keys.match_problems(df, chosen), "id") == [("1.2/i",), ("1.2/ii#1",), ("1.20/i",), ("9/x",)]
    assert rows_of(keys.match_problems(df, spark.createDataFrame([("1.2",)], "selector string")), "id") == [("1.2/i",), ("1.2/ii#1",)]


def test_common_ids(spark):
    evals = spark.createDataFrame([("m1", "a"), ("m1", "b"), ("m2", "a"), ("m2", "a"), ("m2", "c")], "model string, id string")
    assert rows_of(keys.common_ids(evals), "id") == [("a",)]


def test_upsert_order_and_idempotence(spark):
    existing = spark.createDataFrame([("a", "a", 0), ("b", "b", 1), ("z", "z", 2), ("", "blank", 3)], "id string, v string, _pos int")
    new = spark.createDataFrame([("b", "b'", 0), ("c", "c0", 1), ("c", "c", 2), (" ", "blank2", 3)], "id string, v string, _pos int")
    order = spark.createDataFrame([("c", 0), ("b", 1)], "id string, _rank int")
    merged = merge.upsert_rows(existing, new, order)
    got = [r.v for r in merged.orderBy(*merge.upsert_order()).collect()]
    assert got == ["c", "b'", "a", "z", "blank", "blank2"]
    kept = merge.upsert_rows(existing, new, order, keep_blank_ids=False)
    assert [r.v for r in kept.orderBy(*merge.upsert_order()).collect()] == ["c", "b'", "a", "z"]
    again = merge.upsert_rows(kept.select("id", "v", "_pos"), new, order, keep_blank_ids=False)
    assert rows_of(again, "id", "v") == rows_of(kept, "id", "v")


def test_replace_by_base(spark):
    existing = spark.createDataFrame([("1.2/i",), ("1.2/i#1",), ("1.2/i#1#2",), ("1.2/ii",), ("1.2/i2#1",)], "id string")
    updated = spark.createDataFrame([("1.2/i#9",)], "id string")
    bases = spark.createDataFrame([("1.2/i",)], "base string")
    assert rows_of(merge.replace_by_base(existing, updated, bases), "id") == [("1.2/i#9",), ("1.2/i2#1",), ("1.2/ii",)]


def test_prune_keeps_blank_ids_and_unknown_splits(spark):
    artifacts = spark.createDataFrame([("s", "a"), ("s", "gone"), ("s", " "), ("other", "x")], "split string, id string")
    dataset = spark.createDataFrame([("s", "a"), ("s", "b")], "split string, id string")
    plan = merge.prune_plan(artifacts, dataset)
    assert rows_of(plan.filter("status = 'removed'"), "split", "id") == [("s", "gone")]
    assert merge.prune(artifacts, dataset).count() == 3


def test_id_difference(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    right = spark.createDataFrame([("b",), ("c",)], "id string")
    assert rows_of(merge.id_difference(left, right), "id", "side") == [("a", "missing"), ("c", "extra")]


def test_paired_update_counts(spark):
    final = spark.createDataFrame([("s", "1", "old"), ("s", "2", "same"), ("s", "3", "x")], "split string, id string, q string")
    stage = spark.createDataFrame([("s", "1", "new"), ("s", "2", "same"), ("s", "9", "lost")], "split string, id string, nq string")
    updated = merge.paired_update(final, stage, {"q": "nq"})
    assert rows_of(updated, "id", "q", "changed") == [("1", "new", True), ("2", "same", False), ("3", "x", False)]
    assert rows_of(merge.paired_update_counts(updated, stage, final), "split", "targeted", "matched", "changed", "missing") == [("s", 3, 2, 1, 1)]


def test_overlay_last_path_wins_and_false_is_an_answer(spark):
    entry = "struct<question_id:string,annotator_rewritten_question:string,annotator_rewritten_solution:string,annotator_rewritten_answer:string,annotation:string,annotator_comment:string,comment:string,saved_at:string>"
    docs = spark.createDataFrame(
        [
            ("s", "/r/ann/s.json", None, {"1": ("", " New? ", None, "False", None, None, "c", "t1"), "2": ("", "", "", "{}", None, "", None, "")}),
            ("s", "/r/bob/s.json", "Bob", {"1": ("", "", " why ", '{"sympy": "x", "text": "ex"}', None, None, None, "t2")}),
        ],
        f"split string, path string, annotator string, entries map<string,{entry}>",
    )
    entries = overlay.review_entries(docs)
    assert rows_of(entries, "id", "annotator", "has_answer_override") == [("1", "Bob", True), ("2", "ann", False)]
    dataset = spark.createDataFrame([("s", "1", "q", "r"), ("s", "2", "q2", "false")], "split string, id string, question_final string, reference_answer string")
    dataset = dataset.withColumns({c: F.lit(None).cast("string") for c in ("question_standalone", "reference_reasoning", "reference_answer_sympy", "final_answer_for_compare")})
    laid = overlay.apply_overrides(dataset, entries)
    got = rows_of(laid, "id", overlay.effective_question(), overlay.effective_reference(), overlay.effective_symbolic(), overlay.effective_compare())
    assert got == [("1", "q", "ex", "x", "x"), ("2", "q2", "false", "", "false")]


def test_rater_comparison_sees_every_table(spark):
    ds = spark.createDataFrame([("s", "1", "q", "t", "k", "r"), ("s", "2", "q", "t", "k", "r")], "split string, id string, question string, question_type string, answer_kind string, reference_answer string")
    rule = spark.createDataFrame([("s", "1", "false", "d", "p", "r"), ("s", "3", "true", "d", "p", "r")], "split string, id string, is_correct string, detail string, prediction string, reference string")
    judge = spark.createDataFrame([("s", "1", "true", "no", "d", "j", "a", "rr", "pr"), ("s", "4", "maybe", "no", "d", "j", "a", "rr", "pr")], "split string, id string, answer_correct string, reasoning_correct string, detail string, judge_reason string, predict_answer string, reference_reasoning string, predict_reasoning string")
    compared = compare.compare_raters(ds, rule, judge)
    assert rows_of(compared, "id", "comparison_note") == [
        ("1", "rule_fail_llm_pass_answer"), ("2", "missing_both"), ("3", "missing_llm"), ("4", "missing_rule"),
    ]
    total = {r.level: r for r in compare.agreement_summary(compared).collect()}["overall"]
    assert (total.total_compared, total.rows_output, total.rule_wrong_count, total.llm_wrong_reasoning_count) == (4, 2, 1, 2)


def test_align_takes_the_last_row(spark):
    a = spark.createDataFrame([("1", 1, "x"), ("1", 2, "y")], "id string, pos int, v string")
    b = spark.createDataFrame([("1", 5, True)], "id string, pos int, w boolean")
    got = compare.align_by_key({"a": a, "b": b}, ["id"], "pos").collect()
    assert len(got) == 1 and got[0].a.v == "y" and got[0].b.w


def test_tertiles(spark):
    df = spark.createDataFrame([(i,) for i in [3, 1, 2, 7, 6, 5, 4]], "word_count int")
    assert [tuple(r) for r in lengths.tertile_thresholds(df).collect()] == [(2, 4)]
    with pytest.raises(Exception, match="three rows"):
        lengths.tertile_thresholds(df.limit(2)).collect()
    with pytest.raises(ValueError):
        lengths.fixed_thresholds(df, 4, 4)


def test_length_breakdown_row_sums(spark):
    items = spark.createDataFrame([(str(i), "w " * i) for i in range(1, 10)], "id string, q string")
    evals = spark.createDataFrame([("m", "1", True), ("m", "9", None), ("m", "x", True), ("n", "2", False)], "model string, id string, is_correct boolean")
    counted = lengths.item_lengths(items, "q", ["id"])
    binned = lengths.with_bins(counted, lengths.tertile_thresholds(counted))
    got = lengths.length_breakdown(binned, evals)
    for model, matched, extra in [("m", 2, 1), ("n", 1, 0)]:
        rows = got.filter(F.col("model") == model).collect()
        assert len(rows) == 3 and sum(r.total for r in rows) == matched == 9 - rows[0].missing_eval_count
        assert rows[0].extra_eval_count == extra
    empty = got.filter("model = 'n' AND length_bin = 'Long'").collect()[0]
    assert empty.accuracy is None and empty.accuracy_pct == ""


def brute_phrases(text, stop, aliases, phrase_aliases, candidate_stop):
    """The definition, token by token."""
    import re

    tokens = []
    for word in re.findall("[A-Za-z][A-Za-z0-9_]*", re.sub(r"[_^{}$&%#~\\-]", " ", text)):
        token = re.sub("^[0-9]+|[0-9]+$", "", word.lower().strip("_"))
        tokens.append(None if len(token) < 3 or token in stop else aliases.get(token, token))
    out = set()
    for n in (1, 2, 3):
        for i in range(len(tokens) - n + 1):
            gram = tokens[i:i + n]
            if None not in gram and len(set(gram)) == n:
                phrase = " ".join(gram)
                phrase = phrase_aliases.get(phrase, phrase)
                if phrase not in candidate_stop:
                    out.add(phrase)
    return out


WORDS = "discount factor rate interest prices buyers the of equilibrium a1 x9y monopolist high quality 12 low-high level ab éété marginal".split()


def random_questions(seed, n):
    rng = random.Random(seed)
    return [(str(i), "s", " ".join(rng.choices(WORDS, k=rng.randint(0, 25))) + rng.choice(["", ".", "; $x_{12}$"])) for i in range(n)]


def test_phrases_match_the_definition(spark):
    from sparkgrade.functions import wordlists as wl

    data = random_questions(3, 120)
    df = spark.createDataFrame(data, "id string, split string, q string")
    lists = keywords.default_word_lists()
    got = {r.id: set(r.phrases) for r in keywords.question_phrases(df, "q", **lists).collect()}
    want = {
        i: brute_phrases(q, set(lists["stopwords"]), wl.TOKEN_ALIASES, wl.PHRASE_ALIASES, set(wl.CANDIDATE_STOPWORDS))
        for i, _, q in data
    }
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pruning_equals_the_greedy_walk(spark, seed):
    data = random_questions(seed, 60)
    rng = random.Random(seed)
    wrong = [(m, "s", i) for i, _, _ in data for m in ("m1", "m2") if rng.random() < 0.3]
    found = keywords.question_phrases(spark.createDataFrame(data, "id string, split string, q string"), "q", **keywords.default_word_lists())
    wrong_df = spark.createDataFrame(wrong, "model string, split string, id string")
    stats = keywords.keyword_stats(found, wrong_df)
    sets = {r.id: set(r.phrases) for r in found.collect()}
    got = set(map(tuple, keywords.prune_nested(stats, found, wrong_df).select("model", "keyword").collect()))
    want = set()
    for model in ("m1", "m2"):
        held = {}
        for m, _, i in wrong:
            if m == model:
                for phrase in sets[i]:
                    held.setdefault(phrase, set()).add(i)
        ranked = sorted(
            (r for r in stats.filter(F.col("model") == model).collect()),
            key=lambda r: (-r.wrong_question_count, -r.wrong_coverage, -len(r.keyword.split()), -r.lift, r.keyword),
        )
        kept = []
        for r in ranked:
            part = r.keyword.split()
            nested = any(
                len(part) < len(k) and any(k[j:j + len(part)] == part for j in range(len(k))) and held[r.keyword] <= held[" ".join(k)]
                for k in kept
            )
            if not nested:
                kept.append(part)
        want |= {(model, " ".join(k)) for k in kept}
    assert got == want


def test_selected_keywords():
    assert keywords.parse_selected(None) == ["equilibrium", "monopolist", "marginal", "discount factor"]
    assert keywords.parse_selected(" ") == []
    assert keywords.parse_selected("Factor, x,x") == ["discount factor", "x"]


def test_group_merge_equals_union(spark):
    data = [(f"s{i % 3}", str(i % 4), i % 2 == 0, float(i)) for i in range(40)]
    df = spark.createDataFrame(data, "split string, assignment_group string, is_correct boolean, points double")
    df = df.withColumn("points_earned", grading.earned("points", "is_correct"))
    scores = summary.group_scores(df)
    whole = scores.filter("level = 'overall'").select("assignment_group", "total", "correct", "total_points")
    union = df.groupBy("assignment_group").agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), F.sum("points").alias("total_points"))
    assert rows_of(whole, *whole.columns) == rows_of(union, *whole.columns)


def test_empty_table_scores_zero_not_null(spark):
    empty = spark.createDataFrame([], "split string, is_correct boolean, points double, points_earned double")
    assert summary.accuracy_summary(empty, []).filter("accuracy IS NULL").count() == 0


def test_representative_configs_keep_open_families(spark):
    data = [("api", "high", 1, "a"), ("api", "high", 9, "c"), ("api", "high", 9, "b"), ("api", "max", 1, "d"), ("open", "default", 1, "e"), ("open", "default", 2, "f")]
    df = spark.createDataFrame(data, "family string, effort string, max_tokens int, model string")
    assert rows_of(categories.representative_configs(df, ["api"]), "model") == [("b",), ("d",), ("e",), ("f",)]


def test_near_limit_threshold(spark):
    got = spark.range(1).select(rerun.token_threshold(F.lit(32768)).alias("a"), rerun.token_threshold(F.lit(0)).alias("b"), rerun.token_threshold(F.lit(5), absolute=7).alias("c"))
    assert tuple(got.collect()[0]) == (32113, 1, 7)


def test_rerun_list_prefers_named_splits(spark):
    evals = spark.createDataFrame([(0, "", "1", "sympy_parse_failed"), (1, "s", "1", "X JSON_PREDICTION_INVALID"), (2, "s", "2", "ok")], "_pos int, split string, id string, detail string")
    manual = spark.createDataFrame([("2",), ("3",)], "id string")
    assert rows_of(rerun.rerun_by_pattern(evals, manual), "split", "id") == [("", "2"), ("", "3"), ("s", "1")]


def test_layers_are_chosen_per_model_and_split(spark):
    new = spark.createDataFrame([("m", "a", "new")], "model string, split string, v string")
    old = spark.createDataFrame([("m", "a", "old"), ("m", "b", "old")], "model string, split string, v string")
    assert rows_of(layered([new, old]), "split", "v") == [("a", "new"), ("b", "old")]


def test_missing_requested_model_is_an_error(spark):
    evals = spark.createDataFrame([("m", "1")], "model string, id string")
    summaries = spark.createDataFrame([("m",)], "model string")
    assert scored_models(evals, summaries, ["m"]).count() == 1
    with pytest.raises(ValueError, match="n"):
        scored_models(evals, summaries, ["m", "n"])
    with pytest.raises(ValueError):
        scored_models(evals, summaries.limit(0))


def test_rebalance_leaves_equal_labels(spark):
    data = [("s", str(i), "judge", "True" if i < 30 else "False") for i in range(41)]
    df = spark.createDataFrame(data, "split string, id string, question_type string, label string")
    plan = rebalance.rebalance_plan(df)
    assert plan.count() == (30 - 11) // 2 and plan.filter("label = 'False'").count() == 0
    reply = '{"rewritten_question": "q", "new_label": "%s", "flipped": true, "natural": "%s"}'
    checks = spark.createDataFrame([(reply % ("no", "yes"),), (reply % ("yes", "yes"),), (reply % ("no", "no"),), ("{}",)], "r string")
    got = [r.c for r in checks.select(rebalance.rewrite_check("r", F.lit("True")).alias("c")).collect()]
    assert got == [None, "new_label did not flip", "natural is not true", "empty rewritten_question"]


def test_confirmed_buckets(spark):
    export = spark.createDataFrame([("1", "5", None), ("2", "", ["4", " 5 "]), ("3", "", None), ("4", "", None)], "id string, comment string, codes array<string>")
    expert = spark.createDataFrame([("2", True), ("3", True), ("4", False)], "id string, silent boolean")
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    candidates = confirm.bucket_candidates(export, expert, ids("4", "9"), ids("7"))
    resolved = confirm.resolve_candidates(candidates, ids("1", "2", "3", "4"), export, expert)
    assert rows_of(confirm.confirmed_items(resolved), "id", "confirmation_bucket") == [
        ("1", "non_expert_comment_5"), ("2", "expert_silent_no_change"), ("3", "expert_silent_no_change"), ("4", "expert_explicitly_correct"),
    ]
    assert rows_of(resolved.filter("status <> 'selected'"), "id", "status") == [("9", "missing_base")]
