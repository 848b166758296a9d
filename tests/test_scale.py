"""Queries that must use every core, and the exactness of what was made faster for it."""

import decimal
import random
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkgrade.operators import identity, keywords
from sparkgrade.operators.keys import code_bits, maybe_held
from sparkgrade.session import BATCH_CONF, cut_lineage, rows_at_once, shared_folder

FOLDER = "/root/testdata/sf0.001"


def tasks(spark, name: str) -> int:
    """Tasks of the last stage; a small file is read by one."""
    return entry.queries()[name](spark, FOLDER).rdd.getNumPartitions()


def test_exact_identity_is_dealt_out(spark):
    assert tasks(spark, "exact_identity") >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("x", ["1e-30", "1e-14", "-0.003", "0.5", "3.1415926", "-17.25", "12345.678", "-1e9"])
def test_series_are_exact_to_fifty_digits(x):
    x = Decimal(x)
    with decimal.localcontext(identity.CONTEXT):
        cos, sin = identity.turned(x)
        assert abs(cos * cos + sin * sin - 1) < Decimal("1e-55")
        # The series itself, on an argument that decimals reduce to a part of it.
        small = x.remainder_near(2 * identity.PI) / 1024
        term, sums, n = Decimal(1), [Decimal(0), Decimal(0)], 0
        while abs(term) > Decimal("1e-90"):
            sums[n % 2] += -term if n % 4 > 1 else term
            n += 1
            term *= small / n
        for _ in range(10):
            sums = [sums[0] * sums[0] - sums[1] * sums[1], 2 * sums[0] * sums[1]]
        assert abs(cos - sums[0]) < Decimal("1e-52") and abs(sin - sums[1]) < Decimal("1e-52") * max(1, abs(x))
        assert abs(identity.grown(x) / x.exp() - 1) < Decimal("1e-50")


def test_functions_are_evaluated_once_an_argument():
    identity.waves.cache_clear()
    assert identity.verdict("sin(4321*q) + 10**(-12)", "sin(4321*q)") == "not_equal"
    seen = identity.waves.cache_info()
    assert seen.misses <= seen.hits


def test_the_sign_of_zero_does_not_choose_a_branch():
    assert identity.verdict("log(6/(-2))", "log(-3)") == "equal"


def test_nearly_equal_is_dealt_out(spark):
    assert tasks(spark, "nearly_equal") >= spark.sparkContext.defaultParallelism


def test_symbol_audit_is_dealt_out_and_parses_a_contract_once(spark):
    assert tasks(spark, "symbol_audit") >= spark.sparkContext.defaultParallelism
    plan = entry.queries()["symbol_audit"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def written(spark, since: set) -> int:
    """Bytes of the tables below the shared folder that are not in ``since``."""
    return sum(p.stat().st_size for p in tables(spark) - since)


def tables(spark) -> set[Path]:
    return set(Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet"))


def test_packed_texts_come_back_as_they_were(spark):
    noise = random.Random(1)
    long = ["".join(noise.choices("abcdefghijklmnop", k=3000)) for _ in range(40)]
    rows = [(i, t, None if i % 3 else t + "!", "") for i, t in enumerate(long)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string").coalesce(1)
    before = tables(spark)
    packed = cut_lineage(df, "packed", ["b", "a", "c"])
    size = written(spark, before)
    assert packed.columns == df.columns and sorted(packed.collect()) == sorted(df.collect())
    before = tables(spark)
    cut_lineage(df, "plain")
    assert size < 0.7 * written(spark, before)


def test_build_stages_hold_a_question_once(spark, tmp_path):
    noise = random.Random(2)
    texts = [" ".join("".join(noise.choices("abcdefghijklmnop", k=6)) for _ in range(700)) for _ in range(40)]
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet", compression="zstd")
    given = sum(p.stat().st_size for p in Path(tmp_path).rglob("*.parquet"))
    before = tables(spark)
    items = entry.queries()["build_items"](spark, str(tmp_path))
    assert written(spark, before) < 6 * given
    assert items.count() == 80 and items.where("stage3_retry_count = 1").count() == 40


def test_build_counts_writes_no_more_than_its_stages(spark):
    before = tables(spark)
    counts = entry.queries()["build_counts"](spark, FOLDER)
    made = tables(spark) - before
    assert counts.columns == ["split", "stage1", "stage2", "stage3", "final"] and counts.count() > 0
    assert {p.parent.name.split("-")[0] for p in made} == {"stage1", "stage2", "stage3", "aligned"}


def names_of(made: set[Path]) -> set[str]:
    return {p.parent.name.rsplit("-", 1)[0] for p in made}


def test_keyword_pruned_writes_phrases_of_wrong_questions_only(spark):
    before = tables(spark)
    entry.queries()["keyword_pruned"](spark, FOLDER)
    made = tables(spark) - before
    assert names_of(made) == {"wrong-phrases", "wrong-counts", "keywords"}
    [folder] = {str(p.parent) for p in made if p.parent.name.startswith("wrong-phrases")}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 0 OR toxic = 1")
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert spark.read.parquet(folder).count() == documents.join(labels, "doc_id").count()


@pytest.mark.parametrize("size", [1 << 18, 1 << 20])
def test_bitmaps_hold_what_is_marked_and_little_else(spark, size):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("code"), (F.col("id") % 10 == 0).alias("marked"))
    bits = code_bits(rows.where("marked").select("code"), size)
    found = rows.where(maybe_held(F.col("code"), bits, size)).groupBy("marked").count().collect()
    counts = {r.marked: r["count"] for r in found}
    assert counts[True] == 2000 and counts.get(False, 0) < 18_000 * 3 * 2000 / size


def test_statistics_are_the_same_with_and_without_the_bitmap(spark):
    questions = spark.createDataFrame(
        [(str(i), "s", " ".join(["alpha", "beta", "gamma", "delta"][i % 3:]) + f" word{i % 7}x") for i in range(40)], "id string, split string, q string")
    found = keywords.question_phrases(questions, "q")
    wrong = spark.createDataFrame([("m" if i % 2 else "n", "s", str(i)) for i in range(0, 40, 3)] + [("m", "s", "none")], "model string, split string, id string")
    held = cut_lineage(keywords.wrong_questions(found, wrong))
    counts = cut_lineage(keywords.wrong_counts(held, 2))
    plain = keywords.keyword_stats(found, wrong, 2)
    assert plain.count() > 5
    assert sorted(plain.collect()) == sorted(keywords.keyword_stats(found, wrong, 2, held=held, counts=counts).collect())
    asked = keywords.keyword_stats(found, wrong, selected=["alpha", "nowhere"])
    assert {(r.model, r.keyword) for r in asked.collect()} == {(m, k) for m in "mn" for k in ("alpha", "nowhere")}


def test_keyword_links_moves_details_of_linked_questions_only(spark):
    links = entry.queries()["keyword_links"](spark, FOLDER)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "question_preview" in line or "getbit" in line.lower()]
    assert any("getbit" in line.lower() for line in scans)
    assert links.where("question_preview IS NULL OR question_type IS NULL").count() == 0


def test_scorers_get_few_rows_at_once_and_the_setting_comes_back(spark):
    given = spark.conf.get(BATCH_CONF)
    with pytest.raises(ValueError), rows_at_once(spark, 500):
        assert spark.conf.get(BATCH_CONF) == "500"
        raise ValueError
    assert spark.conf.get(BATCH_CONF) == given
    with rows_at_once(spark, 10 ** 9):
        assert spark.conf.get(BATCH_CONF) == given
