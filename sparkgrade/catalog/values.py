"""Catalogue: text, number, JSON, symbol, label and usage columns over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrade.catalog.registry import WS, items, query, table, text
from sparkgrade.functions import answers as an
from sparkgrade.functions import labels as lb
from sparkgrade.functions import symbols as sy
from sparkgrade.functions import text as tx
from sparkgrade.functions import usage
from sparkgrade.operators import generation, grading, keys
from sparkgrade.sources.readers import family_evaluations, with_label_parts

_FLAT = f"trim(regexp_replace(text, '{WS}', ' ', 'g'))"


@query(f"""
    SELECT conv_id, turn, {_FLAT} AS flat, coalesce(nullif({_FLAT}, ''), 'N/A') AS clean,
           len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS words FROM conversations
""")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    """Collapsed texts and word counts."""
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", tx.collapse_spaces("text").alias("flat"), tx.clean_text("text").alias("clean"),
        tx.word_count("text").cast("bigint").alias("words"),
    )


@query("""
    SELECT event_id,
           CASE event_type WHEN 'view' THEN 'True' WHEN 'click' THEN 'False' WHEN 'purchase' THEN 'True' WHEN 'error' THEN 'False' END AS answer,
           CASE event_type WHEN 'purchase' THEN 'true' WHEN 'error' THEN 'false' END AS flag
    FROM events
""")
def normalize_bool(spark: SparkSession, folder: str) -> DataFrame:
    """Boolean answers seen through mark-up, and loose flags."""
    kind = F.col("event_type")
    written = (
        F.when(kind == "view", "$\\boxed{True}$").when(kind == "click", "`no`")
        .when(kind == "purchase", " 1\n").when(kind == "error", "FALSE ").otherwise(kind)
    )
    return table(spark, folder, "events").select(
        "event_id", tx.answer_bool(written).alias("answer"), tx.loose_bool(written).cast("string").alias("flag")
    )


@query("""
    SELECT event_id, CASE event_type WHEN 'error' THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
           -CAST(json_extract_string(props, '$.k') AS BIGINT) AS negative
    FROM events
""")
def parse_ints(spark: SparkSession, folder: str) -> DataFrame:
    """First signed integer of a text, with a default."""
    number = F.get_json_object("props", "$.k")
    source = F.when(F.col("event_type") == "error", "none").otherwise(F.col("props"))
    return table(spark, folder, "events").select(
        "event_id", tx.int_in_text(source, -1).alias("k"),
        tx.int_in_text(F.concat(F.lit("about -"), number, F.lit(".7 of 3")), 0).alias("negative"),
    )


@query(f"""
    WITH s AS (
      SELECT conv_id, turn, coalesce(nullif(regexp_extract({_FLAT}, '^(.*?[.!?]) ', 1), ''), {_FLAT}) AS s FROM conversations)
    SELECT conv_id, turn, CASE WHEN len(string_split(s, ' ')) > 40
      THEN regexp_replace(array_to_string(string_split(s, ' ')[1:40], ' '), '[.,;:!?]+$', '') ELSE s END AS reason FROM s
""")
def reason_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """First sentence of each text, forty words at most."""
    return table(spark, folder, "conversations").select("conv_id", "turn", tx.first_sentence("text").alias("reason"))


@query(f"""
    SELECT doc_id, CASE WHEN length({_FLAT}) <= 180 THEN {_FLAT} ELSE rtrim(left({_FLAT}, 177)) || '...' END AS preview FROM documents
""")
def text_preview(spark: SparkSession, folder: str) -> DataFrame:
    """Collapsed texts cut with an ellipsis."""
    return table(spark, folder, "documents").select("doc_id", tx.preview("text").alias("preview"))


@query("""
    SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS fenced,
           regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS answered, text AS printable FROM documents
""")
def strip_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    """Code fences, reasoning tags and control characters taken off."""
    body = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id",
        tx.strip_code_fence(F.concat(F.lit("```json \n"), body, F.lit("\n```"))).alias("fenced"),
        tx.strip_reasoning_tags(F.concat(
            F.lit("<Think>a\nb</tHINK> lost </think>"), body
        )).alias("answered"),
        tx.strip_control_chars(F.concat(F.lit("\u0001\u000b"), body, F.lit("\u007f"))).alias("printable"),
    )


@query("""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CASE l_returnflag WHEN 'R' THEN 'N/A' WHEN 'A' THEN CAST(CAST(l_quantity AS INT) AS VARCHAR)
                ELSE '\\frac{' || CAST(l_quantity AS INT) || '}{' || l_linenumber || '} + {c}' END AS boxed
    FROM lineitem
""")
def boxed_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Last balanced box of a response; an unbalanced one gives N/A."""
    quantity, line = F.col("l_quantity").cast("int").cast("string"), text("l_linenumber")
    nested = F.concat(F.lit("\\frac{"), quantity, F.lit("}{"), line, F.lit("}  + {c}"))
    response = F.concat(
        F.lit("first \\boxed{0}, then \\boxed{"),
        F.when(F.col("l_returnflag") == "R", F.concat(quantity, F.lit("{")))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit(" "), quantity, F.lit("\n")))
        .otherwise(nested),
        F.lit("} and {more}"),
    )
    response = F.when(F.col("l_returnflag") == "R", F.substring_index(response, "}", 2)).otherwise(response)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", an.boxed_answer(response).alias("boxed")
    )


@query("""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CASE l_returnflag WHEN 'A' THEN 'u_' || l_linenumber || '_D_n_' || CAST(l_quantity AS INT)
                WHEN 'N' THEN 'alpha*sqrt(p_n_' || l_linenumber || ')+epsilon' ELSE 'N/A' END AS expression,
           CASE l_returnflag WHEN 'A' THEN 'u_' || l_linenumber || '_D_n_' || CAST(l_quantity AS INT)
                WHEN 'N' THEN 'alpha,epsilon,p_n_' || l_linenumber ELSE '' END AS symbols,
           CASE l_returnflag WHEN 'A' THEN 'u_' || l_linenumber || '_D_n_' || CAST(l_quantity AS INT)
                WHEN 'N' THEN 'alpha*sqrt(p_n_' || l_linenumber || ')+epsilon' ELSE 'x' END AS converted,
           l_returnflag = 'N' AS symbolic_text
    FROM lineitem
""")
def normalize_expressions(spark: SparkSession, folder: str) -> DataFrame:
    """Expressions in normal form, their symbols, and replies of a converter cleaned up."""
    quantity, line = F.col("l_quantity").cast("int").cast("string"), text("l_linenumber")
    flag = F.col("l_returnflag")
    raw = F.when(
        flag == "A", F.concat(F.lit("u_"), line, F.lit("(D,  "), quantity, F.lit(")"))
    ).when(flag == "N", F.concat(F.lit("\\alpha*sqrt( p("), line, F.lit(") )+\\varepsilon"))).otherwise(" ")
    reply = F.concat(F.lit("<think>\nno</think>\n```python\nignored\n`"), raw, F.lit("`\n```"))
    expression = tx.let(sy.normalize_expression(raw), lambda normal: F.struct(
        normal.alias("normal"), F.array_join(sy.tokens_of_normal(normal), ",").alias("symbols"),
    ))
    rows = table(spark, folder, "lineitem").withColumn("x", expression)
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("x.normal").alias("expression"), "x.symbols",
        F.when(flag == "R", an.converted_expression(F.lit("``` \n ```"), F.lit("x")))
        .otherwise(an.converted_expression(reply, F.lit("x"))).alias("converted"),
        (an.looks_like_math(raw) & (flag == "N")).alias("symbolic_text"),
    )


@query("""
    SELECT s_suppkey, repeat('f_', CAST(12 + s_suppkey % 5 AS INT)) || 'x + g_n_' || s_nationkey AS expression FROM supplier
""")
def deep_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls nested twelve to sixteen deep, flattened to one name."""
    depth = (F.col("s_suppkey") % 5 + 12).cast("int")
    nested = F.concat(F.repeat(F.lit("f("), depth), F.lit("x"), F.repeat(F.lit(")"), depth), F.lit(" + g("), text("s_nationkey"), F.lit(")"))
    return table(spark, folder, "supplier").select("s_suppkey", sy.normalize_expression(nested).alias("expression"))


@query("""
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a": "5"} and more' WHEN 1 THEN '{"b":"{\\"x\\":\\"u\\",\\"y\\":[1,{\\"p\\":2,\\"q\\":\\"' || event_type || '\\"}]}"}'
        WHEN 2 THEN '{"a":"true","b":"x True","c":"N/A","d":"false"}' ELSE '{"k":"' || event_type || '"}' END AS canonical
    FROM events
""")
def json_strict(spark: SparkSession, folder: str) -> DataFrame:
    """Text behind an object, nested keys in any order, and Python's literals."""
    kind, case = F.col("event_type"), F.col("event_id") % 4
    written = (
        F.when(case == 0, '{"a": "5"} and more')
        .when(case == 1, F.concat(F.lit('{"b": {"y": [1, {"q": "'), kind, F.lit('", "p": 2}], "x": "u"}}')))
        .when(case == 2, "{'a': True, 'b': 'x True', 'c': None, 'd': False}")
        .otherwise(F.concat(F.lit('{"k": "'), kind, F.lit('"}')))
    )
    return table(spark, folder, "events").select("event_id", an.json_or_text(written, an.json_answer(written)).alias("canonical"))


def _k() -> Column:
    return F.get_json_object("props", "$.k")


@query("""
    SELECT event_id, CASE event_type WHEN 'error' THEN '{broken' WHEN 'signup' THEN '[1, 2]'
             ELSE '{"a b":"' || event_type || '","k":"' || json_extract_string(props, '$.k') || '"}' END AS canonical,
           CASE event_type WHEN 'click' THEN 'a b' WHEN 'view' THEN '' WHEN 'purchase' THEN 'zz' END AS extra,
           CASE event_type WHEN 'click' THEN 'kk' WHEN 'view' THEN '' WHEN 'purchase' THEN 'k' END AS missing
    FROM events
""")
def json_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """JSON answers in canonical form, and keys beyond or short of the reference."""
    kind = F.col("event_type")
    pair = F.concat(F.lit('"k": '), _k(), F.lit(', " a b ": "'), kind, F.lit(' "'))
    written = (
        F.when(kind == "error", "{broken").when(kind == "signup", "[1,  2]")
        .when(kind == "click", pair)
        .when(kind == "view", F.concat(F.lit("```json\n{"), pair, F.lit("}\n```")))
        .otherwise(F.concat(F.lit("{'k': 'old', "), F.replace(pair, F.lit('"'), F.lit("'")), F.lit("}")))
    )
    answer = an.json_answer(written)
    gold = (
        F.when(kind == "click", F.create_map(F.lit("k"), F.lit("1"), F.lit("kk"), F.lit("2")))
        .when(kind == "view", F.create_map(F.lit("k"), F.lit("1"), F.lit("a b"), F.lit("2")))
        .otherwise(F.create_map(F.lit("k"), F.lit("1"), F.lit("a b"), F.lit("2")))
    )
    other = F.when(kind == "purchase", F.create_map(F.lit("a b"), F.lit("1"), F.lit("zz"), F.lit("2"))).otherwise(answer)
    return table(spark, folder, "events").select(
        "event_id", an.json_or_text(written, answer).alias("canonical"),
        F.when(kind.isin("click", "view", "purchase"), F.array_join(an.json_extra_keys(gold, other), ",")).alias("extra"),
        F.when(kind.isin("click", "view", "purchase"), F.array_join(an.json_missing_keys(gold, other), ",")).alias("missing"),
    )


@query("""
    SELECT p_partkey, split_part(p_name, ' ', 1) || ',' || split_part(p_name, ' ', 2) AS allowed,
           CASE p_type WHEN 'SMALL' THEN 'extra' ELSE '' END AS mismatch,
           'Q ' || p_partkey || E'\\n\\nSymbols (for final answer):\\n- `' || least(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2))
             || CASE WHEN split_part(p_name, ' ', 1) < split_part(p_name, ' ', 2) THEN '`: the first' ELSE '`' END
             || CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN '' ELSE E'\\n- `'
             || greatest(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2))
             || CASE WHEN split_part(p_name, ' ', 1) > split_part(p_name, ' ', 2) THEN '`: the first' ELSE '`' END END AS question
    FROM part
""")
def symbol_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Symbol contracts, symbols off the list, and the section appended to a question."""
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    contract = F.concat(
        F.lit('{"allowed_symbols": ["'), second, F.lit('", "'), first, F.lit('", "pi", "2x"], "symbol_definitions": {"'),
        first, F.lit('": " the first ", "zz": "none"}}'),
    )
    parts = keys.spread(table(spark, folder, "part").select("p_partkey", "p_name", "p_type"))
    rows = parts.withColumn("contract", sy.parse_contract(contract))
    allowed = F.col("contract.allowed_symbols")
    expression = F.concat(first, F.lit(" + sqrt("), second, F.lit(")"), F.when(F.col("p_type") == "SMALL", "*extra").otherwise(""))
    old = F.concat(F.lit("Q "), text("p_partkey"), F.lit("  \n\nSymbols (for final answer):\n- `old`"))
    return rows.select(
        "p_partkey",
        F.concat_ws(",", first, second).alias("allowed"),
        F.array_join(sy.symbol_mismatch(expression, allowed), ",").alias("mismatch"),
        sy.replace_symbol_section(old, allowed, F.col("contract.symbol_definitions")).alias("question"),
    )


@query("""
    SELECT p_partkey, p_name || '__effort-high__max-tokens-' || (p_size * 1024) AS label, 'high' AS effort,
           CAST(p_size * 1024 AS BIGINT) AS max_tokens, p_name || ' high' AS shown,
           regexp_replace(p_name, '[^A-Za-z0-9._-]+', '-', 'g') AS tag,
           CASE WHEN p_name LIKE '%bolt' THEN 'bolts' WHEN p_name LIKE 'red %' THEN 'reds' ELSE p_name END AS family,
           CASE WHEN p_name LIKE 'red %' AND p_name NOT LIKE '%bolt' THEN split_part(p_name, ' ', 2) ELSE 'high' END AS variant
    FROM part
""")
def label_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Artifact labels built, and taken apart into effort, budget, family and variant."""
    label = lb.artifact_label(F.concat("p_name", F.lit("__effort-high")), F.lit("HIGH "), F.col("p_size") * 1024)
    families = [
        {"tag": "bolts", "patterns": [" bolt$"]},
        {"tag": "reds", "needles": ["RED"], "patterns": ["^nothing$"], "prefix": "red "},
    ]
    rows = table(spark, folder, "part").withColumn("model", label)
    parts = with_label_parts(rows, families)
    return parts.select(
        "p_partkey", F.col("model").alias("label"), "effort", "max_tokens", lb.display_name("model").alias("shown"),
        lb.model_tag("p_name").alias("tag"), "family", "variant",
    )


@query("""
    WITH evals AS (SELECT p_partkey, p_name, p_size FROM part),
    counted AS (SELECT DISTINCT p_name FROM part WHERE p_name NOT LIKE '%gear')
    SELECT p_partkey, CASE WHEN p_name LIKE '%bolt' THEN 'bolts' ELSE 'reds' END AS family,
           CASE WHEN p_name LIKE '%bolt' THEN 'high' ELSE split_part(p_name, ' ', 2) END AS variant
    FROM evals JOIN counted USING (p_name) WHERE p_name LIKE '%bolt' OR p_name LIKE 'red %'
""")
def family_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluations of known families only, without models whose summary counts nothing."""
    families = [{"tag": "bolts", "patterns": [" bolt$"]}, {"tag": "reds", "patterns": ["^red "], "prefix": "red "}]
    model = F.concat("p_name", F.lit("__effort-high__max-tokens-9"))
    rows = table(spark, folder, "part").withColumn("model", model)
    summaries = rows.groupBy("model").agg(F.count_if(~F.col("p_name").like("%gear")).alias("total"))
    return family_evaluations(rows, summaries, families).select("p_partkey", "family", "variant")


@query("""
    SELECT doc_id, 'chapter_' || regexp_replace(source, '[^A-Za-z0-9]+', '_', 'g') || '_7' AS split, source || '_7' AS chapter,
           lang || '/' || source AS base, lang AS big, 'c.' || doc_id AS sub, source || '__' || lang AS tagged,
           source AS file_split, lang AS file_tag
    FROM documents
""")
def split_names(spark: SparkSession, folder: str) -> DataFrame:
    """Split, chapter, base, group and file names of items."""
    split = lb.split_name(F.concat("source", F.lit("/7")))
    stem = F.concat_ws("__", "source", "lang")
    return table(spark, folder, "documents").select(
        "doc_id", split.alias("split"), lb.split_chapter(split).alias("chapter"),
        lb.base_id("lang", "source").alias("base"),
        lb.big_question(F.concat("lang", F.lit(" /x/"), "source")).alias("big"),
        lb.sub_id(F.array(F.lit(" c"), F.lit(" "), text("doc_id")), F.lit("main")).alias("sub"),
        stem.alias("tagged"), lb.file_split(stem).alias("file_split"), lb.file_tag(stem).alias("file_tag"),
    )


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS id, lang AS split, source AS chapter FROM documents WHERE source IN ('src1', 'src12')
""")
def chapter_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Items of the selected chapters, however the selector is written."""
    names = [s.strip() for s in "SRC1 , chapter_src12".split(",")]
    wanted = table(spark, folder, "documents").select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("selector")
    ).select(lb.chapter_selector("selector").alias("chapter")).distinct()
    rows = items(spark, folder).withColumn("_key", F.lower("chapter"))
    return rows.join(wanted.select(F.col("chapter").alias("_key")), "_key", "left_semi").select("id", "split", "chapter")


@query("""
    SELECT lang || '/' || source || '/' || doc_id AS id, n_chars FROM documents
    WHERE (lang = 'en' AND source = 'src3') OR lang = 'de' OR CAST(n_chars AS VARCHAR) IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders)
""")
def problem_match(spark: SparkSession, folder: str) -> DataFrame:
    """Items whose id lies below a selector, or whose problem number equals one."""
    rows = table(spark, folder, "documents").select(
        F.concat_ws("/", "lang", "source", text("doc_id")).alias("id"), F.col("n_chars").alias("problem_number")
    )
    orders = table(spark, folder, "orders").select(text("o_orderkey").alias("selector"))
    named = orders.sparkSession.createDataFrame([("en/src3",), (" de ",)], "selector string")
    return keys.match_problems(rows, named.unionByName(orders)).select("id", F.col("problem_number").alias("n_chars"))


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS id, lang AS split FROM documents
    WHERE CAST(doc_id AS VARCHAR) IN (SELECT unnest(regexp_split_to_array(text, '[\\s,]+')) FROM documents)
       OR doc_id IN (3, 14, 15)
""")
def id_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Items named in a list of ids (here: numbers found in the texts, and three by hand)."""
    from_text = table(spark, folder, "documents").select(F.explode(F.split("text", r"[\s,]+")).alias("id")).distinct()
    by_hand = keys.id_list(spark, "3, 14\n15 ,")
    return keys.keep_ids(items(spark, folder), from_text.unionByName(by_hand)).select("id", "split")


@query("""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS input, CAST(floor(value) AS BIGINT) AS output,
           CAST(CASE event_type WHEN 'view' THEN 7 ELSE 0 END AS BIGINT) AS created, CAST(0 AS BIGINT) AS read, event_type AS tier,
           CASE event_type WHEN 'error' THEN 'rate' ELSE '' END AS code, 'message ' || event_type AS message, '429' AS status
    FROM events
""")
def usage_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and error fields out of raw provider JSON."""
    kind = F.col("event_type")
    raw = F.to_json(F.struct(
        F.struct(
            F.lit(0).alias("input_tokens"), _k().cast("int").alias("prompt_tokens"),
            F.floor("value").alias("output_tokens"),
            F.when(kind == "view", F.struct(F.lit(7).alias("ephemeral_5m_input_tokens"))).alias("cache_creation"),
        ).alias("usage"),
        kind.alias("service_tier"),
    ))
    error = F.to_json(F.struct(
        F.when(kind != "error", "").alias("code"), F.concat(F.lit("message "), kind).alias("message"),
        F.lit(429).alias("status_code"),
        F.when(kind == "error", F.struct(F.struct(F.lit("rate").alias("code")).alias("error"))).alias("body"),
    ))
    tokens, failure = usage.usage_fields(raw), usage.error_fields(error)
    return table(spark, folder, "events").select(
        "event_id", tokens["usage_input_tokens"].alias("input"), tokens["usage_output_tokens"].alias("output"),
        tokens["usage_cache_creation_tokens"].alias("created"), tokens["usage_cache_read_tokens"].alias("read"),
        tokens["service_tier"].alias("tier"), failure["error_code"].alias("code"),
        failure["error_message"].alias("message"), failure["http_status"].alias("status"),
    )


@query("""
    SELECT item_id, 'Question:' || chr(10) || text || chr(10) || chr(10) || 'Expected answer type: json' || chr(10)
      || 'Put the final answer in exactly one \\boxed{...}.' || chr(10)
      || 'Answer with one strict JSON object with the keys: q1, q2' AS request,
      'Question:' || chr(10) || text || chr(10) || chr(10) || 'Expected answer type: sympy' || chr(10)
      || 'Put the final answer in exactly one \\boxed{...}.' || chr(10) || 'Use no symbols but: x, y' AS symbolic_request
    FROM benchmark
""")
def prompt_column(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with question, expected type and the rules of that type."""
    def words(*names: str) -> Column:
        return F.array(*[F.lit(n) for n in names])

    return table(spark, folder, "benchmark").select(
        "item_id",
        generation.solve_request("text", F.lit("JSON "), words("x"), words("q1", " q2", "")).alias("request"),
        generation.solve_request("text", F.lit(None).cast("string"), words("x", " y "), words("q1")).alias("symbolic_request"),
    )


@query("""
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'bool' WHEN 'O' THEN 'json' ELSE 'sympy' END AS kind,
           CASE WHEN o_orderpriority = '2-HIGH' THEN 'json' WHEN o_orderstatus = 'F' THEN 'exact' WHEN o_orderstatus = 'O' THEN 'json' ELSE 'sympy' END AS mode
    FROM orders
""")
def answer_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Answer kind and comparison mode with their fallbacks."""
    kind = F.when(F.col("o_orderstatus") == "F", " Bool").when(F.col("o_orderstatus") == "O", "JSON").otherwise("weird")
    mode = F.when(F.col("o_orderpriority") == "2-HIGH", "Json ").otherwise("?")
    return table(spark, folder, "orders").select(
        "o_orderkey", grading.answer_kind(kind).alias("kind"), grading.comparison_mode(mode, kind).alias("mode")
    )
