"""Secret scans through a trigram inverted index, in DataFrame functions only.

Every rule's expression gives a Boolean trigram query (``trigrams``). The index holds, for
the trigrams that the rules ask for, postings (trigram, text key). Postings are intersected
per key, which says which rules can match a text at all; only those expressions run over
it. Rules without a mandatory trigram scan every text.

Keys hash id and text. A key that two rows share merely makes both candidates, and every
candidate is verified, so no hash collision changes a result.

Defined cases: a NULL text counts as empty and has no spans; equal rows each get a row;
NULL ids are kept; other columns travel in ``doc`` and cannot clash; spans of different
kinds may overlap, of one kind never; equal starts are ordered by the kind's place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.llm.common import row_key, whole
from sparkgrade.llm.trigrams import Query, trigram_query

SPAN = "struct<start:int,kind:int,end:int>"


@dataclass(frozen=True)
class Rule:
    """``pattern``: a regular expression; matches are kept where ``group`` has ``least``
    characters or more. Dropped matches still use up their text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pay_key", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z]{2,12}://[A-Za-z0-9_.%-]+:[A-Za-z0-9_.%!-]+@"),
)
RULES = BASE + ADDED


def postings(docs: DataFrame, queries: list[Query]) -> DataFrame:
    """The index for the trigrams of ``queries``: one row (trigram, key) per text that holds it."""
    wanted = sorted({t for q in queries if q for s in q for t in s})
    low = F.array(F.lower("_text"))  # bound once for all trigrams
    held = F.transform(low, lambda x: F.filter(F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(x, t)))[0]
    return docs.select("_key", F.explode(held).alias("trigram"))


def satisfied(query: Query, trigrams: Column) -> Column:
    found = F.lit(False)
    for needed in sorted(query, key=sorted):
        part = F.lit(True)
        for trigram in sorted(needed):
            part = part & F.array_contains(trigrams, trigram)
        found = found | part
    return found


def candidates(docs: DataFrame, rules: tuple[Rule, ...], queries: list[Query]) -> DataFrame:
    """Keys with the kinds whose trigram queries hold: postings intersected per key."""
    held = postings(docs, queries).groupBy("_key").agg(F.collect_set("trigram").alias("trigrams"))
    able = [F.when(satisfied(q, F.col("trigrams")), F.lit(i)) for i, q in enumerate(queries) if q is not None]
    kinds = F.filter(F.array(*able), lambda k: k.isNotNull())
    return held.select("_key", kinds.alias("_kinds")).where(F.size("_kinds") > 0)


def matches(rule: Rule, at: int, text: Column) -> Column:
    """The rule's leftmost non-overlapping matches as spans (code points, end exclusive)."""
    pattern = F.lit(rule.pattern)
    parts = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
        F.split(text, rule.pattern, -1).alias("between"),
    )

    def walk(x: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["pos"] + F.length(F.get(x["between"], i))
            end = start + F.length(F.get(x["found"], i))
            span = F.struct(start.alias("start"), F.lit(at).alias("kind"), end.alias("end"))
            kept = F.length(F.get(x["value"], i)) >= rule.least
            return F.struct(end.alias("pos"), F.when(kept, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

        first = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["found"]) - 1), first, step)["spans"]

    return F.when(text.rlike(rule.pattern), F.transform(F.array(parts), walk)[0]).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc (all its columns), base and spans
    (spans of the first ``base`` rules and of all, ordered by start and kind)."""
    queries = [trigram_query(r.pattern) for r in rules]
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), row_key("doc_id", "text").alias("_key"))
    keyed = docs.select(row_key("doc_id", "text").alias("_key"), whole().alias("_text"))
    joined = held.join(candidates(keyed, rules, queries), "_key", "left")
    text, none = F.coalesce(F.col("doc.text"), F.lit("")), F.array().cast(f"array<{SPAN}>")
    kinds = F.coalesce("_kinds", F.array().cast("array<int>"))
    found = []
    for i, rule in enumerate(rules):
        spans = matches(rule, i, text)
        found.append((spans if queries[i] is None else F.when(F.array_contains(kinds, i), spans).otherwise(none)).alias(f"s{i}"))
    each = joined.select("doc", *found)
    return each.select(
        "doc",
        F.array_sort(F.concat(*[F.col(f"s{i}") for i in range(base)])).alias("base"),
        F.array_sort(F.concat(*[F.col(f"s{i}") for i in range(len(rules))])).alias("spans"),
    )


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, number of spans of each base kind, digest of the base spans, all spans."""
    found = scan(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc.doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and n_chars, if there, counted anew."""
    text = F.col("doc.text")

    def step(state: Column, span: Column) -> Column:
        before = F.substring(text, state["pos"] + 1, F.greatest(span["start"] - state["pos"], F.lit(0)))
        inside = span["start"] < state["pos"]
        return F.struct(
            F.greatest(state["pos"], span["end"]).alias("pos"),
            F.when(inside, state["out"]).otherwise(F.concat(state["out"], before, F.lit(mark))).alias("out"),
        )

    first = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    def rest(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, state["pos"] + 1, F.length(text)))

    clean = F.when(F.size("spans") > 0, F.aggregate("spans", first, step, rest)).otherwise(text)
    changed = {"text": clean}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length(clean).cast(kind)).otherwise(F.col("doc.n_chars"))
    return scan(docs).select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
