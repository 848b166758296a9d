"""Text columns: white space, loose booleans, numbers in text, previews, word counts.

Every function takes and returns a ``Column`` and stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "N/A"

# White space at the ends of a text, in any script.
BLANKS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# A word is a run of letters, digits or underscores in any script. The explicit
# classes give the same counts in every regex dialect, unlike \w and \b.
WORD_PATTERN = r"[\p{L}\p{N}_]+"

# Spellings of a loose boolean.
LOOSE_TRUE = ["1", "true", "yes", "y"]
LOOSE_FALSE = ["0", "false", "no", "n"]
# Spellings of a boolean answer.
ANSWER_TRUE = ["true", "t", "yes", "y", "1"]
ANSWER_FALSE = ["false", "f", "no", "n", "0"]


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def null_if_empty(value: Column) -> Column:
    """NULL for an empty string, without computing the value twice."""
    return F.get(F.array_remove(F.array(value), F.lit("")), F.lit(0))


def strip(text: Column | str) -> Column:
    """Remove leading and trailing white space of any kind, not only spaces."""
    return F.btrim(as_column(text), F.lit(BLANKS))


def collapse_spaces(text: Column | str) -> Column:
    """Fold each run of white space into one space and trim. NULL stays NULL."""
    return F.trim(F.regexp_replace(as_column(text), r"(?U)\s+", " "))


def blank_to_null(text: Column | str) -> Column:
    """Stripped text, or NULL when nothing is left."""
    return null_if_empty(strip(text))


def first_text(*texts: Column | str) -> Column:
    """First argument that is neither NULL nor blank, stripped; NULL if there is none."""
    present = F.array_compact(F.array(*[strip(t) for t in texts]))
    return F.get(F.array_remove(present, F.lit("")), F.lit(0))


def clean_text(text: Column | str, default: Column | str = MISSING) -> Column:
    """Collapsed text, or ``default`` when blank."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(null_if_empty(collapse_spaces(text)), fallback)


def or_missing(text: Column | str) -> Column:
    return F.coalesce(blank_to_null(text), F.lit(MISSING))


def words(names: Sequence[str]) -> Column:
    """A fixed list of words as an array (one literal, folded when the plan is optimised)."""
    return F.split(F.lit(",".join(names)), ",") if names else F.array().cast("array<string>")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of ``key`` in a small fixed table of words, NULL when it is not there."""
    entries = ",".join(f"{name}:{value}" for name, value in table.items())
    return F.try_element_at(F.str_to_map(F.lit(entries), F.lit(","), F.lit(":")), key)


def loose_bool(value: Column | str) -> Column:
    """True / False from a loosely typed flag, NULL when it is neither."""
    spellings = dict.fromkeys(LOOSE_TRUE, "true") | dict.fromkeys(LOOSE_FALSE, "false")
    return lookup(F.lower(strip(as_column(value).cast("string"))), spellings).cast("boolean")


def answer_bool(text: Column | str) -> Column:
    """``'True'`` / ``'False'`` from an answer, seeing through boxes, text macros and ``$``."""
    bare = F.regexp_replace(as_column(text), r"\\boxed\{([^{}]*)\}", "$1")
    bare = F.regexp_replace(
        bare, r"\\(?:text|mathrm|operatorname|mathbf|mathit)\s*\{([^{}]*)\}", "$1"
    )
    bare = F.lower(F.regexp_replace(bare, r"(?U)[$`\s]", ""))
    return lookup(bare, dict.fromkeys(ANSWER_TRUE, "True") | dict.fromkeys(ANSWER_FALSE, "False"))


def flip_bool(label: Column | str) -> Column:
    return F.when(as_column(label) == "True", "False").otherwise("True")


def int_in_text(text: Column | str, default: int | Column) -> Column:
    """First signed integer in the text, else ``default``."""
    found = F.regexp_extract(as_column(text).cast("string"), r"[-+]?\d+", 0)
    fallback = default if isinstance(default, Column) else F.lit(default).cast("bigint")
    return F.coalesce(found.try_cast("bigint"), fallback)


def points(value: Column | str) -> Column:
    """A weight written as a number or as a fraction such as ``1/3``; otherwise 1.0."""
    def parse(text: Column) -> Column:
        top = F.regexp_extract(text, r"^([-+]?\d+)\s*/\s*\d+$", 1).try_cast("double")
        bottom = F.regexp_extract(text, r"/\s*(\d+)$", 1).try_cast("double")
        # A failing cast is costly, and it would take suffixes of Java's number texts.
        number = F.when(text.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), text.try_cast("double"))
        return F.when(F.contains(text, F.lit("/")), F.try_divide(top, bottom)).otherwise(number)

    return F.coalesce(let(strip(as_column(value).cast("string")), parse), F.lit(1.0))


def confidence(text: Column | str) -> Column:
    level = F.lower(strip(text))
    return F.when(level.isin("high", "medium", "low"), level).otherwise("low")


def severity(text: Column | str) -> Column:
    level = F.lower(strip(text))
    return F.when(level.isin("error", "warn", "info"), level).otherwise("warn")


def issue_code(text: Column | str, fallback: str = "llm_issue") -> Column:
    """Lower-case identifier made of letters, digits and underscores."""
    code = F.regexp_replace(F.lower(strip(text)), r"[^a-z0-9_]+", "_")
    return F.coalesce(null_if_empty(F.btrim(code, F.lit("_"))), F.lit(fallback))


def first_sentence(text: Column | str, max_words: int = 40) -> Column:
    """First sentence of a reason, cut to ``max_words`` words without trailing punctuation."""
    def cut(sentence: Column) -> Column:
        words = F.split(sentence, " ")
        short = F.rtrim(F.array_join(F.slice(words, 1, max_words), " "), F.lit(".,;:!?"))
        return F.when(F.size(words) > max_words, short).otherwise(sentence)

    raw = clean_text(text, "No reason provided.")
    return let(F.split(raw, r"(?<=[.!?])\s+", 2)[0], cut)


def _cut(flat: Column, max_chars: int, head: Callable[[Column], Column]) -> Column:
    def shortened(whole: Column) -> Column:
        cut = F.concat(head(F.left(whole, F.lit(max_chars - 3))), F.lit("..."))
        return F.when(F.length(whole) <= max_chars, whole).otherwise(cut)

    return F.coalesce(let(flat, shortened), F.lit(""))


def preview(text: Column | str, max_chars: int = 180) -> Column:
    """Collapsed text, cut with an ellipsis."""
    return _cut(collapse_spaces(text), max_chars, F.rtrim)


def shorten(text: Column | str, max_chars: int) -> Column:
    """Stripped text, cut with an ellipsis, inner white space kept."""
    return _cut(strip(text), max_chars, lambda head: head)


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(as_column(text), F.lit(WORD_PATTERN)), F.lit(0))


def strip_control_chars(text: Column | str) -> Column:
    """Drop control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(as_column(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def strip_code_fence(text: Column | str) -> Column:
    """Remove one Markdown code fence around the text, with its language tag."""
    def unfence(body: Column) -> Column:
        inner = F.regexp_replace(body, r"(?U)^```[a-zA-Z]*\s*|\s*```$", "")
        return F.when(F.startswith(body, F.lit("```")), strip(inner)).otherwise(body)

    return F.coalesce(let(strip(text), unfence), F.lit(""))


def strip_reasoning_tags(text: Column | str) -> Column:
    """Drop ``<think>`` blocks, then everything before a lone closing tag."""
    open_close = F.regexp_replace(as_column(text), r"(?is)<think>.*?</think>", "")
    return strip(F.substring_index(open_close, "</think>", -1))


def keep_stem(original: Column | str, part: Column | str, number: Column | str) -> Column:
    """Prefix a part with its parent question unless it already quotes the parent.

    Quoting means holding the whole parent, or its first 160 characters.
    """
    stem = F.coalesce(strip(original), F.lit(""))
    body = F.coalesce(strip(part), F.lit(""))
    joined = F.concat(
        stem, F.lit("\n\n[Split target "), as_column(number).cast("string"), F.lit("] "), body
    )
    quoted = F.contains(body, stem) | F.contains(body, F.left(stem, F.lit(160)))
    return F.when((stem == "") | quoted, body).when(body == "", stem).otherwise(joined)


def percent_text(accuracy: Column) -> Column:
    """A ratio as a percentage with one decimal; NULL gives an empty string."""
    return F.when(accuracy.isNull(), "").otherwise(F.format_string("%.1f", accuracy * 100.0))


def ratio(top: Column, bottom: Column) -> Column:
    """Share of a total; 0.0 when the total is zero."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
