from pyspark.sql import functions as F

from sparkgrade.functions import answers as an
from sparkgrade.functions import labels as lb
from sparkgrade.functions import order as od
from sparkgrade.functions import symbols as sy
from sparkgrade.functions import text as tx
from sparkgrade.functions import usage as us


def test_last_boxed(apply):
    cases = {
        r"\boxed{1} … \boxed{\frac{a}{b}+{c}}": r"\frac{a}{b}+{c}",
        r"\boxed{a{b}": "N/A",
        r"text \boxed{ x } tail } {": "x",
        r"\boxed{}": "N/A",
        "none": "N/A",
    }
    assert apply(an.last_boxed, list(cases)) == list(cases.values())


def test_answer_bool(apply):
    cases = {r"$\text{True}$": "True", "`no`": "False", "maybe": None, " Y \n": "True", "0": "False", "": None}
    assert apply(tx.answer_bool, list(cases)) == list(cases.values())


def test_loose_bool_keeps_unknown(apply):
    assert apply(tx.loose_bool, ["1", "NO", "perhaps", None, " yes "]) == [True, False, None, None, True]


def test_points(apply):
    got = apply(tx.points, ["2", "1/3", "x", None, "1/0", "-2 / 4"])
    assert got == [2.0, 1 / 3, 1.0, 1.0, 1.0, -0.5]


def test_blank_is_null_but_zero_and_false_are_values(apply):
    assert apply(tx.blank_to_null, ["  \n", "0", "False", None]) == [None, "0", "False", None]


def test_clean_text_folds_unicode_space(apply):
    assert apply(tx.clean_text, ["a  b\n", " ", None]) == ["a b", "N/A", "N/A"]


def test_int_in_text(apply):
    assert apply(lambda c: tx.int_in_text(c, 9), ["a -12.5", "", "x", "7 8"]) == [-12, 9, 9, 7]


def test_first_sentence(apply):
    long = " ".join(["w"] * 45) + "."
    assert apply(tx.first_sentence, ["One. Two!", long, None]) == ["One.", " ".join(["w"] * 40), "No reason provided."]


def test_word_count_is_unicode(apply):
    assert apply(tx.word_count, ["naïve a_b, c1 été", None]) == [4, 0]


def test_keep_stem(apply):
    stem = "S" * 200
    got = apply(lambda c: tx.keep_stem(F.lit(stem), c, F.lit(2)), ["ask", stem[:160] + " ask", ""])
    assert got == [f"{stem}\n\n[Split target 2] ask", stem[:160] + " ask", stem]


def test_normalize_expression(apply):
    cases = {
        "D(p)": "D_p",
        "u_i(D,R)": "u_i_D_R",
        "sqrt( x )": "sqrt(x)",
        r"\alpha*\varepsilon": "alpha*epsilon",
        "f(g(x), h(y**2))": "f_g_x_h_y_pow_2",
        "p(p)+exp(p)": "p_p+exp(p)",
        "Q(-1, 2.5)": "Q_minus_1_n_2_5",
        "f()": "f",
        "2x(p)": "2x(p)",
        " ": "N/A",
        "sqrt(f(x) ) + Max(g(1), b)": "sqrt(f_x) + Max(g_n_1, b)",
    }
    assert apply(sy.normalize_expression, list(cases)) == list(cases.values())


def test_twelve_levels_of_calls_flatten(apply):
    nested = "x"
    for i in range(12):
        nested = f"f{i}({nested})"
    flat = "_".join([f"f{i}" for i in reversed(range(12))] + ["x"])
    assert apply(sy.normalize_expression, [nested]) == [flat]


def test_symbol_mismatch(apply):
    allowed = F.array(F.lit("a"))
    assert apply(lambda c: sy.symbol_mismatch(c, allowed), ["a+b", "a*pi", "N/A"]) == [["b"], [], []]
    none = F.array().cast("array<string>")
    assert apply(lambda c: sy.symbol_mismatch(c, none), ["a+b"]) == [[]]


def test_contract(apply):
    raw = '{"allowed_symbols": ["b", " a ", "a", "pi", "2x"], "symbol_definitions": {"a": " x ", "zz": "no"}}'
    got = apply(sy.parse_contract, [raw, "bad", None])
    assert got[0].allowed_symbols == ["a", "b"] and got[0].symbol_definitions == {"a": "x"}
    assert got[1].allowed_symbols == [] and got[2].symbol_definitions == {}


def test_symbol_section(apply):
    allowed, meaning = F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit("first"))
    section = "Symbols (for final answer):\n- `a`: first\n- `b`"
    assert apply(lambda c: sy.ensure_symbol_section(c, allowed, meaning), ["Q?", "", f"Q\n{section}"]) == [
        f"Q?\n\n{section}", section, f"Q\n{section}",
    ]
    assert apply(lambda c: sy.replace_symbol_section(c, allowed, meaning), ["Q?\nSymbols (for final answer):\n- old"]) == [
        f"Q?\n\n{section}"
    ]


def test_json_answer(apply):
    cases = {
        '"q1": "1/4", "q2": "1/4"': {"q1": "1/4", "q2": "1/4"},
        '```json\n{"b": 2, "a": "x  y"}\n```': {"a": "x y", "b": "2"},
        "{'a': 1}": {"a": "1"},
        "[1,2]": None,
        "N/A": None,
        '{"a": {"z": 1}, "a": "2", " k ": " ", " ": 1}': {"a": "2", "k": "N/A"},
        "{bad": None,
    }
    assert apply(an.json_answer, list(cases)) == list(cases.values())


def test_looks_like_math(apply):
    assert apply(an.looks_like_math, ["a+b", "x_1", "two words", "yes", "7", "", None]) == [
        True, True, False, False, True, False, False,
    ]


def test_converted_expression(apply):
    cases = ["<think>a</think> ```py\n \\boxed{x + f(2)} ```", "a</think>b", "l1\n `y*2`\n", " "]
    assert apply(lambda c: an.converted_expression(c, F.lit("fb")), cases) == ["x + f_n_2", "b", "y*2", "fb"]


def test_natural_order(spark):
    ids = ["10.1/i", "1.10/ii#2", "1.2/main", "1.2/i", "1.02/j", "A2", "a10", "a", "9" * 60, "1" + "0" * 60]
    rows = spark.createDataFrame([(i,) for i in ids], "id string")
    got = [r.id for r in od.sort_by_keys(rows, od.natural_key("id")).collect()]
    assert got == ["1.2/i", "1.02/j", "1.2/main", "1.10/ii#2", "10.1/i", "9" * 60, "1" + "0" * 60, "a", "A2", "a10"]


def test_chapter_and_group_order(spark):
    rows = spark.createDataFrame([(s,) for s in ["chapter_10", "x", "chapter_intro", "chapter_2", "chapter_6_7"]], "s string")
    got = [r.s for r in od.sort_by_keys(rows, od.chapter_key("s")).collect()]
    assert got == ["chapter_intro", "chapter_2", "chapter_10", "chapter_6_7", "x"]
    groups = spark.createDataFrame([(g,) for g in ["10", "b", "9", "a"]], "g string")
    assert [r.g for r in od.sort_by_keys(groups, od.group_key("g")).collect()] == ["9", "10", "a", "b"]


def test_labels(apply):
    assert apply(lambda c: lb.artifact_label(c, F.lit("High"), F.lit("32768")), ["m", "m__effort-high"]) == [
        "m__effort-high__max-tokens-32768"
    ] * 2
    assert apply(lambda c: lb.artifact_label(c, F.lit(" "), F.lit("-1")), ["m"]) == ["m"]
    assert apply(lb.artifact_effort, ["m__effort-max__max-tokens-5", "m"]) == ["max", "default"]
    assert apply(lb.artifact_max_tokens, ["m__max-tokens-5", "m"]) == [5, 0]
    assert apply(lb.model_tag, ["a/b c--d.", " "]) == ["a-b-c-d", "model"]
    assert apply(lb.split_name, ["6/7", "?"]) == ["chapter_6_7", "chapter_unknown"]
    assert apply(lb.chapter_selector, ["Chapter_6_7", "6/7"]) == ["6/7", "6/7"]
    assert apply(lb.dataset_tag, ["My data_dataset", "_"]) == ["My_data", "dataset"]


def test_first_matching_rule_tags(apply):
    rules = [{"tag": "A", "patterns": ["^x-"], "needles": ["Model 32"]}, {"tag": "B", "patterns": ["model"]}]
    assert apply(lambda c: lb.tag_by_rules([c], rules), ["my-MODEL-32b", "a model", "X-1", "none"]) == ["A", "B", "A", None]


def test_assignment_group(apply):
    def group(c):
        return lb.assignment_group(F.lit("chapter_assignment"), F.lit(""), c, F.lit("7"))

    assert apply(group, ["12/a#1", "x/1", " 3 #2", None]) == ["12", "7", "3", "7"]
    assert apply(lambda c: lb.assignment_group(F.lit("chapter_1"), F.lit("1"), c), ["12/a"]) == [""]


def test_usage_fields(apply):
    raw = '{"usage": {"input_tokens": 0, "prompt_tokens": 5, "completion_tokens": 7, "cache_creation": {"ephemeral_5m_input_tokens": 3}}, "service_tier": "s"}'
    got = apply(lambda c: F.struct(*[v.alias(k) for k, v in us.usage_fields(c).items()]), [raw, "x"])
    assert got[0][:5] == (5, 7, 3, 0, "s") and got[1][:5] == (0, 0, 0, 0, "")


def test_json_answers_are_whole_objects(apply):
    def shown(column):
        return an.json_or_text(column, an.json_answer(column))

    cases = {
        '{"a": "5"} trailing words': '{"a": "5"} trailing words',
        '{"a": "5"}}': '{"a": "5"}}',
        '{"b": {"y": 1, "x": {"q": 2, "p": [3, 4]}}}': '{"b":"{\\"x\\":{\\"p\\":[3,4],\\"q\\":2},\\"y\\":1}"}',
        "{'a': True, 'b': 'not True', 'c': None}": '{"a":"true","b":"not True","c":"N/A"}',
        '{"a": "it is True"}': '{"a":"it is True"}',
        "": "N/A",
    }
    assert apply(shown, list(cases)) == list(cases.values())


def test_points_take_numbers_only(apply):
    values = ["2f", "2d", "0x10", "1e1", ".5", "3.", "1/4", "NaN", None]
    assert apply(tx.points, values) == [1.0, 1.0, 1.0, 10.0, 0.5, 3.0, 0.25, 1.0, 1.0]


def test_calls_flatten_at_any_depth(apply):
    deep = "".join(f"f{i}(" for i in range(20)) + "x" + ")" * 20
    assert apply(sy.normalize_expression, [deep, "f(g(x),sqrt(h(y)))"]) == [
        "_".join(f"f{i}" for i in range(20)) + "_x", "f(g_x,sqrt(h_y))",
    ]
