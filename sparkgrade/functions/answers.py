"""Answer columns: boxed answers, JSON answers, math tests, conversion clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgrade.functions import symbols
from sparkgrade.functions import text as tx
from sparkgrade.functions.text import MISSING, as_column

BOX = "\\boxed{"
QUOTED_OR_NOT = r""""(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|[^"']+|["']"""


def last_boxed(text: Column | str) -> Column:
    r"""Content of the last ``\boxed{...}`` with balanced braces, else ``N/A``.

    The tail behind the last marker is cut at its braces; one pass over those pieces
    tracks the depth and how many pieces belong to the box, so no text is rebuilt
    along the way however long the answer is.
    """
    text = as_column(text)

    def step(state: Column, piece: Column) -> Column:
        change = F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        moved = F.struct(
            (state["depth"] + change).alias("depth"), (state["used"] + 1).alias("used")
        )
        return F.when(state["depth"] == 0, state).otherwise(moved)

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("used"))

    def finish(state: Column) -> Column:
        return F.when(state["depth"] == 0, state["used"])

    def content(parts: Column) -> Column:
        used = F.aggregate(parts, start, step, finish)
        return F.array_join(F.slice(parts, F.lit(1), used - 1), "")

    def inside(tail: Column) -> Column:
        nested = tx.let(F.regexp_extract_all(tail, F.lit(r"[^{}]+|[{}]"), F.lit(0)), content)
        flat = F.substring_index(tail, "}", 1)
        return F.when(tail.rlike(r"^[^{}]*+\}"), flat).otherwise(nested)

    boxed = tx.null_if_empty(tx.strip(tx.let(F.substring_index(text, BOX, -1), inside)))
    return F.coalesce(F.when(F.contains(text, F.lit(BOX)), boxed), F.lit(MISSING))


def boxed_answer(response: Column | str) -> Column:
    """Last box with its white space folded."""
    return tx.clean_text(last_boxed(response))


def json_answer(raw: Column | str) -> Column:
    """A JSON object answer as ``map<string,string>``, or NULL when it is no object.

    Code fences are removed; a bare ``"k": v`` fragment is wrapped in braces; single
    quotes and ``True``, ``False``, ``None`` are accepted; text behind the object is not.
    Scalars are collapsed text (``N/A`` when blank), nested values compact JSON with
    sorted keys. Keys are trimmed, blank keys dropped, the last of repeated keys kept.
    """
    def unfence(body: Column) -> Column:
        opened = F.regexp_replace(body, r"^```(?:json)?\s*|\s*```$", "")
        return F.when(F.startswith(body, F.lit("```")), opened).otherwise(body)

    def wrap(body: Column) -> Column:
        fragment = (
            ~F.startswith(body, F.lit("{"))
            & ~F.endswith(body, F.lit("}"))
            & body.rlike(r'^\s*"[^"]+"\s*:')
        )
        whole = F.when(fragment, F.concat(F.lit("{"), body, F.lit("}"))).otherwise(body)
        return F.when(F.startswith(whole, F.lit("{")), whole)

    def literals(body: Column) -> Column:
        def spelled(piece: Column) -> Column:
            swapped = F.regexp_replace(F.regexp_replace(piece, r"\bNone\b", "null"), r"\bTrue\b", "true")
            return F.when(piece.rlike("^[\"']"), piece).otherwise(F.regexp_replace(swapped, r"\bFalse\b", "false"))

        pieces = F.regexp_extract_all(body, F.lit(QUOTED_OR_NOT), F.lit(0))
        return F.when(body.rlike(r"\b(?:True|False|None)\b"), F.array_join(F.transform(pieces, spelled), "")).otherwise(body)

    def object_alone(body: Column) -> Column:
        # Text behind the object keeps the second field from being read.
        held = F.from_json(F.concat(F.lit('{"v":'), body, F.lit(',"end":"."}')), "v map<string,string>, end string")
        return tx.let(held, lambda h: F.when(h["end"] == ".", h["v"]))

    def value_text(value: Column) -> Column:
        ordered = F.to_json(F.try_parse_json(value))
        return F.coalesce(F.when(value.rlike(r"^\s*[{\[]"), ordered), tx.clean_text(value))

    def tidy(entry: Column) -> Column:
        return F.struct(tx.strip(entry["key"]).alias("key"), value_text(entry["value"]).alias("value"))

    def last_of_each(pairs: Column) -> Column:
        return F.filter(
            pairs,
            lambda e, i: (e["key"] != "") & ~F.exists(
                F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"]
            ),
        )

    body = tx.let(tx.let(tx.let(tx.strip(raw), unfence), wrap), literals)
    pairs = F.transform(F.map_entries(tx.let(body, object_alone)), tidy)
    return F.map_from_entries(F.array_sort(tx.let(pairs, last_of_each)))


def json_text(answer: Column) -> Column:
    """Canonical text of a JSON answer: sorted keys, no blanks."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(answer))))


def json_or_text(raw: Column | str, parsed: Column) -> Column:
    """Canonical JSON when the answer parsed, else its collapsed text."""
    return F.coalesce(json_text(parsed), tx.clean_text(raw))


def json_extra_keys(gold: Column, answer: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(answer), F.map_keys(gold)))


def json_missing_keys(gold: Column, answer: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(gold), F.map_keys(answer)))


def looks_like_math(text: Column | str) -> Column:
    def test(flat: Column) -> Column:
        shaped = flat.rlike(r"[+\-*/^=()\d]|^[A-Za-z_]\w*$")
        return (flat != MISSING) & shaped & tx.answer_bool(flat).isNull()

    return F.coalesce(tx.let(tx.collapse_spaces(text), test), F.lit(False))


def looks_symbolic(text: Column | str) -> Column:
    """Usable as an expression as it stands: no TeX commands or dollar signs."""
    def test(body: Column) -> Column:
        return ~body.isin("", MISSING) & ~body.rlike(r"[\\$]")

    return F.coalesce(tx.let(tx.strip(text), test), F.lit(False))


def converted_expression(raw: Column | str, fallback: Column | str) -> Column:
    """Expression out of a converter's reply: fences and tags off, last box, last line."""
    def unbox(body: Column) -> Column:
        box = last_boxed(body)
        return F.when(F.contains(body, F.lit(BOX)) & (box != MISSING), box).otherwise(body)

    def last_line(body: Column) -> Column:
        lines = F.transform(F.split(body, r"\r\n|\r|\n"), lambda line: tx.strip(line))
        return F.coalesce(F.try_element_at(F.array_remove(lines, F.lit("")), F.lit(-1)), body)

    body = tx.let(tx.strip_code_fence(tx.strip_reasoning_tags(raw)), unbox)
    line = F.btrim(tx.strip(tx.let(body, last_line)), F.lit("`"))
    expression = F.get(F.array_remove(F.array(symbols.normalize_expression(line)), F.lit(MISSING)), F.lit(0))
    return F.coalesce(expression, tx.or_missing(fallback))
