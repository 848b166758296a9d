"""Catalogue: grading by mode, numeric identity, judge replies, response processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrade.catalog.registry import everything, query, table, text
from sparkgrade.functions import symbols as sy
from sparkgrade.operators import generation, grading, identity, judging
from sparkgrade.operators.keys import spread


@query("""
    WITH t AS (
      SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'O' THEN 'two words' ELSE 'False' END AS gold,
             CASE WHEN o_totalprice > 250000 THEN 'True' WHEN o_totalprice > 100000 THEN 'two words' ELSE 'False' END AS given
      FROM orders)
    SELECT o_orderkey, given, gold, given = gold AS is_correct FROM t
""")
def exact_grade(spark: SparkSession, folder: str) -> DataFrame:
    """Exact comparison: booleans in any spelling, else collapsed text."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    gold = F.when(status == "F", "\\boxed{yes}").when(status == "O", "two\n words ").otherwise("$f$")
    given = F.when(price > 250000, "T").when(price > 100000, " two words").otherwise("\\mathrm{no}")
    return table(spark, folder, "orders").select(
        "o_orderkey", grading.exact_value(given).alias("given"), grading.exact_value(gold).alias("gold"),
        grading.exact_grade(given, gold).alias("is_correct"),
    )


def _orders_as_items(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as items: the priority decides the kind of answer, the status its reference."""
    kind, status, price = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    number = F.when(status == "F", 1).when(status == "O", 2).otherwise(3).cast("string")
    reference = (
        F.when(kind == "1-URGENT", F.when(status == "F", "True").otherwise(" no "))
        .when(kind == "2-HIGH", F.when(status == "F", "Band   A").otherwise("Band B"))
        .when(kind == "3-MEDIUM", F.concat(F.lit("(x + "), number, F.lit(")**2")))
        .when(kind == "4-NOT SPECIFIED", '{"q2": "x+y", "q1": "1/4", "ok": "1"}')
        .otherwise("D(p)+1")
    )
    return table(spark, folder, "orders").select(
        text("o_orderkey").alias("id"), status.alias("split"),
        F.when(kind == "1-URGENT", "bool").when(kind == "2-HIGH", "TEXT").when(kind == "3-MEDIUM", "sympy")
        .when(kind == "4-NOT SPECIFIED", "json").otherwise(" ").alias("answer_kind"),
        F.when(kind == "3-MEDIUM", " SymPy ").otherwise("").alias("comparison_mode"),
        reference.alias("reference_answer"),
        F.when(price > 250000, "1/3").otherwise("2").alias("points"),
    )


def _orders_as_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to the same items; one combination of columns has none."""
    kind, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    high = F.col("o_totalprice") > 250000
    number = F.when(status == "F", 1).when(status == "O", 2).otherwise(3)
    constant = number * number + F.when(high, 0).otherwise(1)
    expanded = F.concat(
        F.lit("x**2 + "), (number * 2).cast("string"), F.lit("*x + "), constant.cast("string")
    )
    json = (
        F.when((status == "F") & high, '"q1": "0.25", "q2": "y + x", "ok": "Yes"')
        .when(status == "F", '{"q1": "1/4", "q2": "x-y", "ok": "no"}')
        .when((status == "O") & high, '{"q1": "1/4"}')
        .when(status == "O", '{"q1": "1/4", "q2": "x+y", "ok": "true", "zz": "5"}')
        .otherwise("[1,  2]")
    )
    given = (
        F.when(kind == "1-URGENT", F.when(high, "$\\text{true}$").otherwise("`F`"))
        .when(kind == "2-HIGH", F.when(high, "Band A").otherwise(" Band\n B "))
        .when(kind == "3-MEDIUM", expanded)
        .when(kind == "4-NOT SPECIFIED", json)
        .otherwise(F.when(status == "F", "D_p +  1").when(status == "O", "D_p + z").otherwise("2x"))
    )
    answered = ~((kind == "3-MEDIUM") & (status == "P") & ~high)
    return table(spark, folder, "orders").filter(answered).select(
        text("o_orderkey").alias("id"), status.alias("split"), F.lit(" ").alias("answer_sympy"),
        given.alias("final_answer_for_compare"), F.lit("unused").alias("answer_boxed"),
    )


_DISPATCH_SQL = """
    WITH t AS (
      SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS split, o_orderpriority AS kind, o_orderstatus AS s,
             o_totalprice > 250000 AS high, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS n FROM orders),
    graded AS (
      SELECT *, kind = '3-MEDIUM' AND s = 'P' AND NOT high AS missing,
        CASE kind WHEN '1-URGENT' THEN 'exact' WHEN '2-HIGH' THEN 'exact' WHEN '4-NOT SPECIFIED' THEN 'json' ELSE 'sympy' END AS comparison_mode,
        CASE kind WHEN '1-URGENT' THEN CASE WHEN high THEN 'True' ELSE 'False' END
                  WHEN '2-HIGH' THEN CASE WHEN high THEN 'Band A' ELSE 'Band B' END
                  WHEN '3-MEDIUM' THEN 'x**2 + ' || 2 * n || '*x + ' || (n * n + CASE WHEN high THEN 0 ELSE 1 END)
                  WHEN '4-NOT SPECIFIED' THEN CASE WHEN s = 'F' AND high THEN '{"ok":"Yes","q1":"0.25","q2":"y + x"}'
                       WHEN s = 'F' THEN '{"ok":"no","q1":"1/4","q2":"x-y"}' WHEN s = 'O' AND high THEN '{"q1":"1/4"}'
                       WHEN s = 'O' THEN '{"ok":"true","q1":"1/4","q2":"x+y","zz":"5"}' ELSE '[1, 2]' END
                  ELSE CASE s WHEN 'F' THEN 'D_p + 1' WHEN 'O' THEN 'D_p + z' ELSE '2x' END END AS given,
        CASE kind WHEN '1-URGENT' THEN CASE WHEN s = 'F' THEN 'True' ELSE 'False' END
                  WHEN '2-HIGH' THEN CASE WHEN s = 'F' THEN 'Band A' ELSE 'Band B' END
                  WHEN '3-MEDIUM' THEN '(x + ' || n || ')**2'
                  WHEN '4-NOT SPECIFIED' THEN '{"ok":"1","q1":"1/4","q2":"x+y"}' ELSE 'D(p)+1' END AS reference,
        CASE kind WHEN '1-URGENT' THEN (s = 'F') = high WHEN '2-HIGH' THEN (s = 'F') = high WHEN '3-MEDIUM' THEN high
                  WHEN '4-NOT SPECIFIED' THEN s = 'F' AND high ELSE s = 'F' END AS ok
      FROM t),
    verdicts AS (
      SELECT *, NOT missing AND ok AS is_correct, CASE WHEN missing THEN 'missing_prediction'
        WHEN comparison_mode = 'exact' THEN CASE WHEN ok THEN 'exact_equal' ELSE 'exact_not_equal' END
        WHEN kind = '3-MEDIUM' THEN CASE WHEN ok THEN 'sympy_equal' ELSE 'sympy_not_equal' END
        WHEN kind = '4-NOT SPECIFIED' THEN CASE WHEN ok THEN 'json_equal' WHEN s = 'F' THEN 'json_not_equal'
          WHEN s = 'P' THEN 'json_prediction_invalid' WHEN high THEN 'json_missing_keys' ELSE 'json_extra_keys' END
        WHEN s = 'F' THEN 'sympy_equal' WHEN s = 'O' THEN 'sympy_not_equal_with_symbol_mismatch'
        ELSE 'sympy_parse_failed_with_symbol_mismatch' END AS detail
      FROM graded)"""


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    joined = grading.grade_join(_orders_as_items(spark, folder), _orders_as_answers(spark, folder))
    return grading.grade(joined)


@query(f"""
    {_DISPATCH_SQL}
    SELECT split, id, comparison_mode, CASE WHEN missing THEN 'N/A' ELSE given END AS prediction, reference, is_correct, detail,
           kind = '5-LOW' AND s <> 'F' AS symbol_mismatch,
           CASE WHEN kind = '5-LOW' AND s = 'O' THEN 'z' WHEN kind = '5-LOW' AND s = 'P' THEN 'x' ELSE '' END AS mismatch_symbols,
           round(CASE WHEN high THEN 1 / 3 ELSE 2 END, 6) AS points,
           round(CASE WHEN NOT is_correct THEN 0 WHEN high THEN 1 / 3 ELSE 2 END, 6) AS points_earned
    FROM verdicts
""")
def grade_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Rule grades of answers of every kind, missing ones included."""
    return _graded(spark, folder).select(
        "split", "id", "comparison_mode", "prediction", "reference", "is_correct", "detail", "symbol_mismatch",
        F.array_join("mismatch_symbols", ",").alias("mismatch_symbols"),
        F.round("points", 6).alias("points"), F.round("points_earned", 6).alias("points_earned"),
    )


@query(f"""
    {_DISPATCH_SQL}
    SELECT id, k.key AS key, CASE WHEN s = 'O' AND high AND key <> 'q1' THEN 'N/A' ELSE json_extract_string(given, key) END AS prediction,
           json_extract_string(reference, key) AS reference,
           CASE key WHEN 'q1' THEN true WHEN 'q2' THEN NOT (s = 'O' AND high) AND NOT (s = 'F' AND NOT high)
                ELSE NOT (s = 'O' AND high) AND NOT (s = 'F' AND NOT high) END AS is_correct,
           CASE WHEN s = 'O' AND high AND key <> 'q1' THEN 'missing_key'
                WHEN key = 'ok' THEN CASE WHEN s = 'F' AND NOT high THEN 'exact_not_equal' ELSE 'exact_equal' END
                WHEN key = 'q2' AND s = 'F' AND NOT high THEN 'sympy_not_equal' ELSE 'sympy_equal' END AS detail,
           CASE WHEN s = 'O' AND high THEN 'ok,q2' ELSE '' END AS missing_keys, CASE WHEN s = 'O' AND NOT high THEN 'zz' ELSE '' END AS extra_keys
    FROM verdicts, (VALUES ('ok'), ('q1'), ('q2')) k(key) WHERE kind = '4-NOT SPECIFIED' AND s <> 'P'
""")
def json_grade(spark: SparkSession, folder: str) -> DataFrame:
    """JSON answers key by key, with missing and extra keys."""
    graded = _graded(spark, folder)
    return graded.select(
        "id", F.explode("json_items").alias("i"), F.array_join("json_missing_keys", ",").alias("missing_keys"),
        F.array_join("json_extra_keys", ",").alias("extra_keys"),
    ).select("id", "i.*", "missing_keys", "extra_keys")


@query("""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CASE WHEN l_returnflag = 'R' THEN 'parse_failed'
                WHEN l_quantity = l_linenumber * l_linenumber THEN 'equal' ELSE 'not_equal' END AS verdict
    FROM lineitem
""")
def numeric_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an expanded expression equals its factored form."""
    line, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    expanded = F.concat(
        F.lit("x^2 + "), (line * 2).cast("string"), F.when(F.col("l_returnflag") == "R", "x + ").otherwise("*x + "),
        quantity.cast("string"),
    )
    factored = F.concat(F.lit("(x + "), line.cast("string"), F.lit(")**2"))
    verdict = identity.expression_verdict(sy.normalize_expression(expanded), sy.normalize_expression(factored))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", verdict.alias("verdict")
    )


@query("""
    SELECT p_partkey, p_size % 8 IN (6, 7) AS same FROM part
""")
def exact_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Expressions that differ by very little, relatively or absolutely, are not the same."""
    n, case = (F.col("p_partkey") + 1).cast("string"), F.col("p_size") % 8
    pairs = [
        ("10**(-9)*{n}", "2*10**(-9)*{n}"), ("x/10**10 + {n}", "y/10**10 + {n}"), ("1000000*x*{n}", "1000000*x*{n} + 0.001"),
        ("{n}/3", "{n}*0.333333333"), ("2**100 + {n}", "2**100 + 1 + {n}"), ("log(exp({n}*x))", "{n}*x"),
        ("(x + {n})**2", "x**2 + 2*{n}*x + {n}*{n}"), ("exp({n} + x)", "exp({n})*exp(x)"),
    ]

    def written(side: int) -> Column:
        shown = F.lit(None).cast("string")
        for i, pair in enumerate(pairs):
            shown = F.when(case == i, F.replace(F.lit(pair[side]), F.lit("{n}"), n)).otherwise(shown)
        return shown

    verdict = identity.expression_verdict(written(0), written(1))
    parts = spread(table(spark, folder, "part").select("p_partkey", "p_size"))
    return parts.select("p_partkey", (verdict == identity.EQUAL).alias("same"))


@query("""
    SELECT p_partkey, p_partkey % 6 = 5 AS same FROM part
""")
def nearly_equal(spark: SparkSession, folder: str) -> DataFrame:
    """Functions whose difference is tiny against their values are told apart."""
    n, case = (F.col("p_partkey") + 1).cast("string"), F.col("p_partkey") % 6
    pairs = [
        ("sqrt(10**20*{n}**2) + 1", "10**10*{n}"), ("sqrt(x)*10**12*{n} + 1", "sqrt(x)*10**12*{n}"), ("sin({n}*x) + 10**(-12)", "sin({n}*x)"),
        ("exp({n}*x) + 10**(-15)*exp({n}*x)", "exp({n}*x)"), ("sqrt(2)*{n}", "1.41421356237*{n}"), ("sin(2*{n}*x)", "2*sin({n}*x)*cos({n}*x)"),
    ]

    def written(side: int) -> Column:
        return F.replace(F.element_at(F.array(*[F.lit(p[side]) for p in pairs]), (case + 1).cast("int")), F.lit("{n}"), n)

    verdict = identity.expression_verdict(written(0), written(1))
    return spread(table(spark, folder, "part").select("p_partkey")).select("p_partkey", (verdict == identity.EQUAL).alias("same"))


def _relations(column: str) -> tuple[Column, Column]:
    """Pairs of relations, written differently, from a number and a kind."""
    n, kind = text("l_linenumber"), F.col(column)
    left = (
        F.when(kind == "A", F.concat(F.lit("Eq(x, "), n, F.lit("*y)")))
        .when(kind == "N", F.concat(F.lit("x < "), n))
        .otherwise(F.concat(F.lit("[Eq(a, "), n, F.lit("), Eq(b, 2)]")))
    )
    right = (
        F.when(kind == "A", F.concat(n, F.lit("*y")))
        .when(kind == "N", F.lit("3 > x"))
        .otherwise(F.lit("And(Eq(b - 2, 0), Eq(a, 4))"))
    )
    return left, right


@query("""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linenumber = 3) OR (l_returnflag = 'R' AND l_linenumber = 4)
                THEN 'equal' ELSE 'not_equal' END AS verdict
    FROM lineitem
""")
def relation_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Relations: equation against expression, reversed inequality, unordered lists."""
    left, right = _relations("l_returnflag")
    verdict = identity.expression_verdict(sy.normalize_expression(left), sy.normalize_expression(right))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", verdict.alias("verdict")
    )


@query("""
    SELECT count(*) AS parse_targets_total, count(*) FILTER (ok) AS parse_targets_ok,
           count(*) FILTER (NOT ok) AS parse_targets_failed, bool_and(ok) AS all_sympy_targets_parseable
    FROM (SELECT l_linestatus = 'O' AND l_returnflag <> 'R' AS ok FROM lineitem
          UNION ALL SELECT l_linestatus = 'O' FROM lineitem)
""")
def parse_audit(spark: SparkSession, folder: str) -> DataFrame:
    """How many symbolic targets parse; blank and N/A targets count as failed."""
    rows = table(spark, folder, "lineitem").select(
        text("l_orderkey").alias("id"), F.lit("SymPy").alias("comparison_mode"),
        F.when(F.col("l_returnflag") == "R", "3 4").when(F.col("l_linestatus") == "O", "x + f(1)").otherwise(" ")
        .alias("comparable_final_answer"),
        F.when(F.col("l_linestatus") == "O", F.concat(text("l_linenumber"), F.lit("*x"))).otherwise("N/A")
        .alias("reference_answer_sympy"),
    )
    rows = rows.withColumn(
        "comparable_final_answer",
        F.when(F.col("reference_answer_sympy") == "N/A", " ").otherwise(F.col("comparable_final_answer")),
    )
    audit = grading.parse_audit(rows, ["comparable_final_answer", "reference_answer_sympy"])
    return grading.parse_audit_summary(audit)


@query("""
    SELECT conv_id, turn, role = 'assistant' AS answer_correct, role = 'assistant' AND turn = 1 AS reasoning_correct,
           CASE WHEN role = 'assistant' AND turn = 1 THEN 'ok' WHEN role = 'assistant' THEN 'bad_reasoning' ELSE 'both_wrong' END AS detail,
           CASE WHEN role = 'system' THEN 'Judge output parse failed.' ELSE 'Turn ' || turn || '.' END AS judge_reason
    FROM conversations
""")
def judge_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts out of a judge's JSON replies; unusable replies fail both."""
    body = F.to_json(F.struct(
        F.when(F.col("role") == "assistant", "Yes").when(F.col("role") == "user", "0").otherwise("perhaps").alias("is_correct"),
        ((F.col("turn") == 1) & (F.col("role") == "assistant")).alias("reasoning_correct"),
        F.concat(F.lit("Turn "), text("turn"), F.lit(". And:  "), "text").alias("judge_reason"),
    ))
    reply = F.when(F.col("role") == "assistant", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    rows = table(spark, folder, "conversations").select(
        "conv_id", "turn", reply.alias("reply"), F.lit(True).alias("has_answer"), F.lit(1.0).alias("points"),
        F.lit("").alias("request"), F.lit("").alias("question"),
    )
    return judging.judged_rows(rows, "reply").select(
        "conv_id", "turn", "answer_correct", "reasoning_correct", "detail", "judge_reason"
    )


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as stored answers, some of them read with older rules."""
    flag, line = F.col("l_returnflag"), text("l_linenumber")
    box = (
        F.when(flag == "A", F.concat(F.lit("D("), line, F.lit(")")))
        .when(flag == "N", F.concat(F.lit('{"b": "'), line, F.lit('", "a": 1}')))
        .otherwise("\\text{yes}")
    )
    return table(spark, folder, "lineitem").select(
        text("l_orderkey").alias("id"), F.col("l_linestatus").alias("split"),
        F.concat(F.lit("so \\boxed{"), box, F.lit("}")).alias("model_response"),
        F.when(flag == "R", "bool").when(flag == "N", "json").otherwise("sympy").alias("answer_kind"),
        F.when(flag == "R", "exact").when(flag == "N", "json").otherwise("sympy").alias("comparison_mode"),
        F.array(F.lit("D_n_1"), F.lit("x")).alias("symbol_contract_allowed_symbols"),
        F.when(F.col("l_quantity") > 25, F.concat(F.lit("D_n_"), line)).otherwise("N/A").alias("answer_sympy"),
        F.lit("old").alias("answer_boxed"), F.lit(None).cast("map<string,string>").alias("answer_json"),
        F.when(flag == "A", F.concat(F.lit("D_n_"), line)).otherwise("old").alias("final_answer_for_compare"),
        F.array().cast("array<string>").alias("mismatch_symbols"), F.lit(False).alias("symbol_mismatch"),
        "l_partkey", "l_suppkey", "l_linenumber",
    )


@query("""
    SELECT CAST(l_orderkey AS VARCHAR) AS id, l_partkey, l_suppkey, l_linenumber,
           CASE l_returnflag WHEN 'A' THEN 'D(' || l_linenumber || ')' WHEN 'N' THEN '{"b": "' || l_linenumber || '", "a": 1}' ELSE '\\text{yes}' END AS answer_boxed,
           CASE l_returnflag WHEN 'A' THEN 'D_n_' || l_linenumber ELSE 'N/A' END AS answer_sympy,
           CASE l_returnflag WHEN 'A' THEN 'D_n_' || l_linenumber WHEN 'N' THEN '{"a":"1","b":"' || l_linenumber || '"}' ELSE 'True' END AS final,
           l_returnflag = 'A' AND l_linenumber <> 1 AS symbol_mismatch
    FROM lineitem
""")
def process_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Boxed, boolean, JSON and symbolic answers out of responses."""
    rows = generation.process_responses(_responses(spark, folder))
    return rows.select(
        "id", "l_partkey", "l_suppkey", "l_linenumber", "answer_boxed", "answer_sympy",
        F.col("final_answer_for_compare").alias("final"), "symbol_mismatch",
    )


@query("""
    SELECT coalesce(l_linestatus, 'ALL') AS split, count(*) AS rows_total,
           count(*) FILTER (l_returnflag <> 'R' AND l_quantity <= 25) AS targeted,
           count(*) FILTER (l_returnflag <> 'R' AND l_quantity <= 25) AS changed
    FROM lineitem GROUP BY GROUPING SETS ((l_linestatus), ())
""")
def reconvert_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored answers without a usable expression, read again."""
    rows = generation.reconvert(_responses(spark, folder), only_bad=True)
    return generation.reconvert_counts(rows).select(
        everything("split").alias("split"), "rows_total", "targeted", "changed"
    )
