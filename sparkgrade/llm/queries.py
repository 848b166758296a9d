"""The queries of this package over the test tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkgrade.llm import (
    filter_audit, language, line_frequency, merkle, passages, pieces, quality, records, secret_scan, simhash, templates, token_counts, url_rules,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document from the compiled transducer."""
    counts = token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(WORDS))
    return counts.drop("border_tokens")


@query()
def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Piece ids of every document and their decoding, as digests."""
    return pieces.digests(table(spark, folder, "documents"), public_tokenizers.path(PIECES))


@query()
def op8_records(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, written as records and read back."""
    return records.round_trip(table(spark, folder, "documents"), public_tokenizers.path(WORDS), end_id=2)


@query()
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash classes of all documents: 3-word shingles, links at 3 bits or fewer."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def duck_spans(kind: str, at: int, pattern: str, group: int = 0, least: int = 0) -> str:
    """DuckDB: the spans of one kind as a list of {s, k, e, kind}."""
    return f"""list_transform(list_filter(range(1, len(regexp_extract_all(t, '{pattern}')) + 1),
        lambda i: length(regexp_extract_all(t, '{pattern}', {group})[i]) >= {least}), lambda i: {{
        's': CAST(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
        'k': {at},
        'e': CAST(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x)))
            + list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i], lambda x: length(x))) AS BIGINT),
        'kind': '{kind}'}})"""


def duck_written(spans: str) -> str:
    return f"array_to_string(list_transform(list_sort({spans}), lambda x: x.kind || ':' || x.s || ':' || x.e), ',')"


SPANS_SQL = ",\n".join(
    duck_spans(r.kind, i, r.pattern.replace("'", "''"), r.group, r.least) + f" AS s{i}" for i, r in enumerate(secret_scan.RULES)
)


@query(f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, {SPANS_SQL} FROM texts)
SELECT doc_id, len(s0) AS n_assign, len(s1) AS n_access, len(s2) AS n_hex,
    sha256({duck_written("s0 || s1 || s2")}) AS base_sha256,
    {duck_written(" || ".join(f"s{i}" for i in range(len(secret_scan.RULES))))} AS spans
FROM found""")
def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base spans, and all spans."""
    return secret_scan.report(table(spark, folder, "documents"))


@query(r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM t),
wins AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c
    FROM (SELECT rid, i, ws[i:i + 2] AS win FROM w, unnest(range(1, len(ws) - 1)) AS u(i))),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM wins WHERE c > 1) GROUP BY rid),
ls AS (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS line FROM t),
lw AS (SELECT rid, source, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM ls),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lw WHERE n > 0 GROUP BY rid),
norm AS (SELECT rid, source, t, n, regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') AS l
    FROM lw WHERE n > 0),
often AS (SELECT source, l FROM norm GROUP BY source, l HAVING count(DISTINCT t) > 10
    AND count(DISTINCT t) > 0.05 * (SELECT count(DISTINCT d.t) FROM t AS d WHERE d.source IS NOT DISTINCT FROM norm.source AND d.rid IN (SELECT rid FROM norm))),
gone AS (SELECT rid, sum(n) AS n FROM norm JOIN often ON norm.l = often.l AND norm.source IS NOT DISTINCT FROM often.source GROUP BY rid),
stats AS (SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, CAST(len(ws) - coalesce(gone.n, 0) AS BIGINT) AS left_words
    FROM t JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND left_words >= 0.3 * n_words AS kept
FROM stats""")
def op5_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules of every document, with lines frequent on their host removed."""
    return line_frequency.quality_rules(table(spark, folder, "documents"))


@query()
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by a factorisation machine."""
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, known words first and n-grams for the rest."""
    return language.identify(table(spark, folder, "documents"))


@query()
def op3_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other parameters."""
    return templates.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op9_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words or more that documents share, exact or nearly so."""
    return passages.passages(table(spark, folder, "documents"))


def duck_rules(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("('%s', '%s', '%s', %d)" % r for r in rows)


URL_RULES_SQL = duck_rules([(*r, 0) for r in url_rules.BASE_RULES] + [(h, "", "block", 1) for h in url_rules.BLOCKED_HOSTS])


@query(rf"""
WITH rules(h, p, said, rank) AS ({URL_RULES_SQL}),
u AS (SELECT row_number() OVER () AS rid, page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fit AS (SELECT rid, rank, h || p AS rule, said, row_number() OVER (PARTITION BY rid
        ORDER BY rank, length(h) + length(p) DESC, length(h) DESC, h, p) AS n
    FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, CASE WHEN rank = 0 THEN rule END AS rule, coalesce(said, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM fit WHERE n = 1) USING (rid)""")
def op11_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The filter's verdict on every url, and the base rule that decided."""
    return url_rules.report(table(spark, folder, "pages"))


def duck_field(column: str) -> str:
    return f"coalesce(strlen({column}) || ':' || {column}, '-')"


def duck_leaf(text: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in merkle.FIELDS[:-1]]
    return f"sha256({' || '.join(map(duck_field, fields))} || coalesce(strlen({text}) || ':' || {text}, '-'))"


def duck_crc32(column: str) -> str:
    """Unsigned CRC-32 of ASCII text, bit by bit."""
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(range(8), lambda c, i: {step}, xor(r, x))"
    codes = f"list_transform(string_split({column}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda r, x: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def duck_tree(name: str, first: str, levels: int) -> str:
    """CTEs ``name``_1.. of the levels over ``first`` (t, pos, h): each node's parent run, and
    ``name``_trail: for each first node what stands before and behind it, level by level.
    A tree that is down to one node stays as it is."""
    ctes, below = [], first
    for k in range(1, levels + 1):
        ctes.append(f"""{name}_runs{k} AS (SELECT t, pos // 16 AS run, string_agg(h, '' ORDER BY pos) AS cat, max(n) AS n
            FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM {below}) GROUP BY t, pos // 16)""")
        ctes.append(f"{name}_{k} AS (SELECT t, run AS pos, CASE WHEN n > 1 THEN sha256(cat) ELSE cat END AS h FROM {name}_runs{k})")
        below = f"{name}_{k}"
    joins = " ".join(f"JOIN {name}_runs{k} AS r{k} ON r{k}.t = f.t AND r{k}.run = f.pos // {16 ** k}" for k in range(1, levels + 1))
    cut = lambda k, part: f"CASE WHEN r{k}.n > 1 THEN substr(r{k}.cat, {part}) ELSE '' END"
    place = lambda k: f"(f.pos // {16 ** (k - 1)} % 16) * 64"
    columns = ", ".join(f"{cut(k, f'1, {place(k)}')} AS b{k}, {cut(k, f'{place(k)} + 65')} AS a{k}, r{k}.n > 1 AS more{k}" for k in range(1, levels + 1))
    ctes.append(f"{name}_trail AS (SELECT f.t, f.pos, {columns} FROM {first} AS f {joins})")
    ctes.append(f"{name}_root AS (SELECT t, h FROM {below})")
    return ",\n".join(ctes)


def duck_fold_steps(trails: list[tuple[str, int]]) -> tuple[str, str]:
    """CTEs that fold one level after the other, and the last one's name."""
    ctes, below = [], "paths"
    for name, levels in trails:
        for k in range(1, levels + 1):
            step = f"fold_{name}{k}"
            ctes.append(f"{step} AS (SELECT * REPLACE (CASE WHEN {name}_more{k} THEN sha256({name}_b{k} || node || {name}_a{k}) ELSE node END AS node) FROM {below})")
            below = step
    return ",\n".join(ctes), below


LEAF_LEVELS, SOURCE_LEVELS = 5, 3
TRAILS = [("doc", LEAF_LEVELS), ("src", SOURCE_LEVELS)]
FOLDS, LAST_FOLD = duck_fold_steps(TRAILS)
PROOF = " || ".join(f"{n}_b{k} || {n}_a{k}" for n, levels in TRAILS for k in range(1, levels + 1))
PATHS = ", ".join(f"{n}_trail.{c}{k} AS {n}_{c}{k}" for n, levels in TRAILS for k in range(1, levels + 1) for c in ("b", "a", "more"))
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
WITH leaves AS (SELECT doc_id, coalesce('+' || source, '') AS t, {duck_leaf("text")} AS h,
    CASE WHEN {duck_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {duck_leaf(LOWERED)} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves),
{duck_tree("doc", "placed", LEAF_LEVELS)},
subs AS (SELECT 'all' AS t, row_number() OVER (ORDER BY CAST(t AS BLOB)) - 1 AS pos, h, t AS owner FROM doc_root),
{duck_tree("src", "subs", SOURCE_LEVELS)},
paths AS (SELECT p.doc_id, p.h AS leaf, coalesce(p.changed, p.h) AS node, subs.h AS subroot, src_root.h AS root, {PATHS}
    FROM placed AS p JOIN doc_trail ON doc_trail.t = p.t AND doc_trail.pos = p.pos
    JOIN subs ON subs.owner = p.t JOIN src_trail ON src_trail.pos = subs.pos CROSS JOIN src_root),
{FOLDS}
SELECT doc_id, leaf, subroot, root, sha256({PROOF}) AS proof_sha256, node AS folded_root, node = root AS verified FROM {LAST_FOLD}""")
def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of all documents, checked against tampered rows."""
    return merkle.audit(table(spark, folder, "documents"))


@query(rf"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
labelled AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 16 ELSE 0 END AS mask
    FROM words LEFT JOIN labelled USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
orders(o) AS (VALUES {", ".join(f"('{o}')" for o in filter_audit.ORDERS)}),
steps AS (SELECT o AS filter_order, s AS step, 1 << (ascii(o[s]) - 65) AS own,
    CAST(coalesce(list_sum(list_transform(string_split(o[1:s - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)), 0) AS INT) AS before
    FROM orders, unnest(range(1, 6)) AS u(s)),
spread AS (SELECT counts.*, filter_order, CAST(step AS INT) AS step, mask & own <> 0 AS fails, mask & before <> 0 AS earlier, mask = own AS alone FROM counts, steps),
summed AS (SELECT part, filter_order, step,
    coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS removed,
    coalesce(sum(n) FILTER (fails AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0) AS toxic_lost
    FROM spread GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM summed""")
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes in every order, by language."""
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
