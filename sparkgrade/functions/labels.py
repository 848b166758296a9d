"""Label columns: artifact labels, split and chapter names, question groups."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgrade.functions import text as tx
from sparkgrade.functions.text import as_column


def _with_suffix(label: Column, mark: str, value: Column) -> Column:
    suffix = F.concat(F.lit(mark), value)
    done = F.concat(label, suffix)
    return F.when(value.isNull() | F.endswith(label, suffix), label).otherwise(done)


def artifact_label(model: Column | str, effort: Column | str, max_tokens: Column | str) -> Column:
    """``model[__effort-e][__max-tokens-n]``; a suffix already there is not repeated."""
    level = F.lower(tx.blank_to_null(as_column(effort).cast("string")))
    budget = as_column(max_tokens).cast("string").try_cast("bigint")
    budget = F.when(budget > 0, budget.cast("string"))
    return _with_suffix(_with_suffix(as_column(model), "__effort-", level), "__max-tokens-", budget)


def artifact_effort(label: Column | str, recorded: Column | str | None = None) -> Column:
    """Recorded effort, else the one in the label, else ``default``."""
    given = F.lit(None).cast("string") if recorded is None else tx.blank_to_null(recorded)
    found = tx.null_if_empty(F.regexp_extract(as_column(label), "__effort-([a-z0-9]+)__", 1))
    return F.coalesce(F.nullif(given, F.lit("default")), found, F.lit("default"))


def artifact_max_tokens(label: Column | str) -> Column:
    found = F.regexp_extract(as_column(label), r"__max-tokens-(\d+)", 1).try_cast("bigint")
    return F.coalesce(found, F.lit(0).cast("bigint"))


def display_name(label: Column | str) -> Column:
    """Label without the budget, effort set off by a blank."""
    short = F.regexp_replace(as_column(label), r"__max-tokens-\d+", "")
    return F.replace(F.replace(short, F.lit("__effort-"), F.lit(" ")), F.lit("-Instruct"), F.lit(""))


def model_tag(name: Column | str) -> Column:
    """File-safe tag of a model name."""
    tag = F.regexp_replace(tx.strip(name), "[^A-Za-z0-9._-]+", "-")
    tag = F.regexp_replace(F.regexp_replace(tag, "-{2,}", "-"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(tx.null_if_empty(tag), F.lit("model"))


def file_split(stem: Column | str) -> Column:
    """Split part of ``<split>__<tag>``; the whole stem when there is no tag."""
    parts = F.regexp_extract(as_column(stem), "^(.+)__(.+)$", 1)
    return F.when(parts != "", parts).otherwise(as_column(stem))


def file_tag(stem: Column | str) -> Column:
    return tx.null_if_empty(F.regexp_extract(as_column(stem), "^(.+)__(.+)$", 2))


def split_name(chapter: Column | str) -> Column:
    """``6/7`` -> ``chapter_6_7``."""
    body = F.regexp_replace(as_column(chapter), "[^A-Za-z0-9]+", "_")
    body = F.regexp_replace(body, "^_+|_+$", "")
    return F.when(body == "", "chapter_unknown").otherwise(F.concat(F.lit("chapter_"), body))


def split_chapter(split: Column | str) -> Column:
    """``chapter_6_7`` -> ``6_7``; other names unchanged."""
    return F.regexp_replace(tx.strip(split), "^chapter_", "")


def chapter_selector(selector: Column | str) -> Column:
    """Normal form of a chapter selector: ``Chapter_6_7`` and ``6/7`` agree."""
    low = F.lower(tx.strip(selector))
    bare = F.replace(F.regexp_replace(low, "^chapter_", ""), F.lit("_"), F.lit("/"))
    return F.when(F.startswith(low, F.lit("chapter_")), bare).otherwise(low)


def dataset_tag(folder: Column | str) -> Column:
    name = F.regexp_replace(tx.strip(folder), "_dataset$", "")
    tag = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(tx.null_if_empty(tag), F.lit("dataset"))


def big_question(question_id: Column | str) -> Column:
    """Part of an id before the first slash."""
    return tx.strip(F.split_part(as_column(question_id), F.lit("/"), F.lit(1)))


def base_id(number: Column | str, sub_id: Column | str) -> Column:
    return F.concat_ws("/", as_column(number), F.coalesce(tx.blank_to_null(sub_id), F.lit("main")))


def sub_id(path: Column | str, stem: Column | str) -> Column:
    """Sub-question path joined by dots, else the file stem."""
    parts = F.filter(F.transform(as_column(path), lambda p: tx.strip(p)), lambda p: p != "")
    return F.when(F.size(as_column(path)) > 0, F.array_join(parts, ".")).otherwise(as_column(stem))


def assignment_group(split: Column, chapter: Column, *ids: Column) -> Column:
    """Numeric prefix of the first id that has one, only for assignment rows; else ``''``."""
    prefixes = [F.regexp_extract(i, r"(?U)^\s*([0-9]+)\s*(?:[#/]|$)", 1) for i in ids]
    numeric = F.array_remove(F.array_compact(F.array(*prefixes)), F.lit(""))
    in_scope = (tx.collapse_spaces(split) == "chapter_assignment") | (
        tx.collapse_spaces(chapter) == "assignment"
    )
    return F.when(in_scope, F.coalesce(F.get(numeric, F.lit(0)), F.lit(""))).otherwise("")


def tag_by_rules(identifiers: list[Column | str], rules: list[dict]) -> Column:
    """Tag of the first rule that matches one of the identifiers, else NULL.

    A rule is ``{"tag", "patterns", "needles"}``: case-insensitive regular
    expressions, tried first, then substrings compared on letters and digits only.
    Rules are a short hand-written list, so they become one ``CASE`` expression.
    """
    def compact(text: str) -> str:
        return re.sub("[^a-z0-9]+", "", text.lower())

    tags = []
    for rule in rules:
        tests = []
        for identifier in map(as_column, identifiers):
            bare = F.regexp_replace(F.lower(identifier), "[^a-z0-9]+", "")
            tests += [tx.strip(identifier).rlike("(?i)" + p) for p in rule.get("patterns", [])]
            tests += [F.contains(bare, F.lit(compact(n))) for n in rule.get("needles", []) if compact(n)]
        if tests:
            tags.append(F.when(reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests]), rule["tag"]))
    return F.coalesce(*tags) if tags else F.lit(None).cast("string")
