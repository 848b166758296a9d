"""Keywords of wrong answers: tokens, n-grams, coverage, lift, pruning, links.

Candidates are built per question as an array of distinct phrases, so a question
counts once per phrase without any distinct aggregation. Question sets are never
collected: coverage and set inclusion are counts over exploded rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions import labels as lb
from sparkgrade.functions import text as tx
from sparkgrade.functions import wordlists as wl
from sparkgrade.functions.order import natural_key
from sparkgrade.functions.text import as_column
from sparkgrade.operators.keys import code_bits, head_per_group, lookup, maybe_held, members


# Places of the bitmaps of question keys and of phrases.
QUESTION_PLACES, LEAST_PLACES, MOST_PLACES = 1 << 22, 1 << 18, 1 << 28

GAP = "|"
TOKEN = "[a-z0-9]++"


def strip_latex(text: Column | str) -> Column:
    """Drop macros, keeping the content of formatting macros. Other mark-up separates words."""
    def unmarked(body: Column) -> Column:
        plain = F.regexp_replace(
            body, r"\\(?:texttt|textbf|textit|emph|mathrm|mathbf|mathit)\s*\{([^{}]*)\}", " $1 "
        )
        plain = F.regexp_replace(plain, r"\\(?:begin|end)\s*\{[^{}]*\}", " ")
        return F.regexp_replace(plain, r"\\[a-zA-Z]+\*?", " ")

    body = as_column(text)
    return F.when(F.contains(body, F.lit("\\")), unmarked(body)).otherwise(body)


def _by_initial(names: Sequence[str]) -> list[str]:
    """The words as one alternative per first letter, so most are ruled out by one character."""
    groups = groupby(sorted(set(names)), key=lambda name: name[0])
    return [f"{initial}(?:{'|'.join(name[1:] for name in group)})" for initial, group in groups]


def token_text(
    text: Column | str, stopwords: Sequence[str] = (), min_length: int = 3, aliases: dict[str, str] | None = None
) -> Column:
    """The tokens of a text as one string, each between blanks, ``|`` for a gap.

    A token starts with a letter; digits at its end are cut, and it is in lower case. A
    stop word or short token leaves a gap. Aliases apply after the stop-word test.
    Working on one string keeps all of this in a few regular expressions per text
    instead of a lambda per token.
    """
    separated = F.regexp_replace(
        F.concat(F.lit(" "), strip_latex(text), F.lit(" ")), "[0-9]*+[^A-Za-z0-9][^A-Za-z]*+", "  "
    )
    dropped = [f"[a-z0-9]{{1,{min_length - 1}}}"] if min_length > 1 else []
    dropped += _by_initial(stopwords)
    found = F.lower(separated)
    if dropped:
        found = F.regexp_replace(found, f" (?:{'|'.join(dropped)}) ", f" {GAP} ")
    for old, new in (aliases or {}).items():
        found = F.replace(found, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.replace(found, F.lit("  "), F.lit(" "))


def _phrase_pattern(n: int) -> str:
    """Pattern whose group 1 is the phrase of ``n`` different tokens starting at a blank."""
    tokens = [f"({TOKEN})"]
    for i in range(1, n):
        seen = "|".join(rf"\{j + 2}" for j in range(i))
        tokens.append(f"(?!(?:{seen}) )({TOKEN})")
    return f"(?<= )(?=({' '.join(tokens)}) )"


def phrases(
    found: Column, shortest: int = 1, longest: int = 3, aliases: dict[str, str] | None = None, stop: Sequence[str] = ()
) -> Column:
    """Distinct n-grams of a :func:`token_text` that cross no gap and repeat no token.

    Overlapping matches come from a look-ahead, the repeat test from back-references.
    """
    every = F.concat(*[
        F.regexp_extract_all(found, F.lit(_phrase_pattern(n)), F.lit(1)) for n in range(max(1, shortest), longest + 1)
    ])

    def named(raw: Column) -> Column:
        renamed = F.array_compact(F.array(*[
            F.when(F.array_contains(raw, old), F.lit(new)) for old, new in (aliases or {}).items()
        ]).cast("array<string>"))
        return F.concat(F.array_except(raw, tx.words(list(aliases or {}))), renamed)

    # array_except also removes repeats.
    return F.array_except(tx.let(every, named) if aliases else every, tx.words(stop))


def question_phrases(
    questions: DataFrame,
    text: Column | str,
    keys: Sequence[str] = ("split", "id"),
    shortest: int = 1,
    longest: int = 3,
    min_length: int = 3,
    stopwords: Sequence[str] = (),
    candidate_stopwords: Sequence[str] = (),
    token_aliases: dict[str, str] | None = None,
    phrase_aliases: dict[str, str] | None = None,
) -> DataFrame:
    """Key columns and the array ``phrases`` of each question; the text is dropped here."""
    found = tx.let(
        token_text(text, stopwords, min_length, token_aliases),
        lambda t: phrases(t, shortest, longest, phrase_aliases, candidate_stopwords),
    )
    return questions.select(*keys, found.alias("phrases"))


def default_word_lists(keep_generic_terms: bool = False) -> dict:
    """Arguments for :func:`question_phrases` with the fixed word lists."""
    stop = wl.STOPWORDS + wl.ITEM_STOPWORDS
    if not keep_generic_terms:
        stop = stop + wl.GENERIC_STOPWORDS
    return {
        "stopwords": stop,
        "candidate_stopwords": wl.CANDIDATE_STOPWORDS,
        "token_aliases": wl.TOKEN_ALIASES,
        "phrase_aliases": wl.PHRASE_ALIASES,
    }


def parse_selected(raw: str | None) -> list[str]:
    """Keywords from a comma list: absent gives the defaults, blank gives automatic mode."""
    if raw is None:
        return list(wl.SELECTED_KEYWORDS)
    names = [wl.PHRASE_ALIASES.get(p.strip().lower(), p.strip().lower()) for p in raw.split(",")]
    return list(dict.fromkeys(n for n in names if n))


def _exploded(found: DataFrame, phrases: Column, *columns: Column) -> DataFrame:
    """One row per phrase. From an inner explode the optimiser infers a test of the array's
    size and pushes it below the projection, where all phrases are extracted a second time."""
    return found.select(F.explode_outer(phrases).alias("keyword"), *columns).where("keyword IS NOT NULL")


def keyword_frequency(found: DataFrame) -> DataFrame:
    """Number of questions holding each phrase."""
    return _exploded(found, F.col("phrases")).groupBy("keyword").agg(
        F.count("*").alias("question_count")
    )


def _code(*columns: str) -> Column:
    return F.xxhash64(*columns).alias("code")


def wrong_questions(found: DataFrame, wrong: DataFrame, keys: Sequence[str] = ("split", "id")) -> DataFrame:
    """The questions that some model answered wrongly, with ``models`` (at most every model).

    Most others are left out by a bitmap of the keys, before their phrases are made or moved.
    """
    by_question = wrong.select(*keys, "model").distinct().groupBy(*keys).agg(
        F.collect_list("model").alias("models")
    )
    bits = code_bits(wrong.select(_code(*keys)), QUESTION_PLACES)
    return found.where(maybe_held(_code(*keys), bits, QUESTION_PLACES)).join(by_question, list(keys))


def wrong_counts(held: DataFrame, min_wrong: int = 1, selected: Sequence[str] | None = None) -> DataFrame:
    """``n``, the wrong questions that hold a phrase, per model. ``held``: :func:`wrong_questions`."""
    rows = _exploded(held, _chosen(selected), F.col("models"))
    counts = rows.select("keyword", F.explode("models").alias("model")).groupBy("keyword", "model").agg(
        F.count("*").alias("n")
    )
    return counts.where(F.col("n") >= min_wrong)


def _chosen(selected: Sequence[str] | None) -> Column:
    every = F.col("phrases")
    return F.filter(every, lambda p: p.isin(list(selected))) if selected else every


def places_for(n: int) -> int:
    """The size of a bitmap for so many hashes: eight places each, 32 MB at most."""
    return min(MOST_PLACES, max(LEAST_PLACES, 1 << (8 * n - 1).bit_length()))


def keyword_stats(
    found: DataFrame,
    wrong: DataFrame,
    min_wrong: int = 1,
    selected: Sequence[str] | None = None,
    keys: Sequence[str] = ("split", "id"),
    held: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Coverage and lift of each phrase per model.

    ``wrong`` has ``model`` and the keys of wrongly answered questions. Lift over a phrase the
    corpus lacks is infinite. With ``selected`` every model reports every selected keyword.
    ``held`` and ``counts`` are written tables of :func:`wrong_questions` and :func:`wrong_counts`;
    with ``counts``, phrases that no wrong question can hold are left out by a bitmap
    before they are counted over the corpus.
    """
    questions = found.agg(F.count("*")).scalar()
    held = wrong_questions(found, wrong, keys) if held is None else held
    totals = held.select(*keys, "models").dropDuplicates(list(keys)).select(F.explode("models").alias("model")).groupBy(
        "model"
    ).agg(F.count("*").alias("total_wrong"))
    every = _exploded(found, _chosen(selected))
    if counts is None:
        counts = wrong_counts(held, 1 if selected else min_wrong, selected)
    else:
        size = places_for(counts.count())
        every = every.where(maybe_held(_code("keyword"), code_bits(counts.select(_code("keyword")), size), size))
    corpus = every.groupBy("keyword").agg(F.count("*").alias("all_question_count"))
    if selected:
        named = totals.select("model", F.explode(F.array(*[F.lit(s) for s in selected])).alias("keyword"))
        stats = named.join(counts, ["model", "keyword"], "left").join(corpus, "keyword", "left")
        stats = stats.select(
            "model", "keyword", F.coalesce("n", F.lit(0)).alias("wrong_question_count"),
            F.coalesce("all_question_count", F.lit(0)).alias("all_question_count"),
        )
    else:
        stats = counts.join(corpus, "keyword").select(
            "model", "keyword", F.col("n").alias("wrong_question_count"), "all_question_count"
        )
    stats = stats.withColumn("total_wrong", lookup(totals, "model", "total_wrong")[F.col("model")])
    stats = stats.where("total_wrong IS NOT NULL").withColumn("all_total", questions)
    wrong_coverage = F.coalesce(F.try_divide("wrong_question_count", "total_wrong"), F.lit(0.0))
    all_coverage = F.coalesce(F.try_divide("all_question_count", "all_total"), F.lit(0.0))
    lift = F.when(all_coverage == 0, float("inf")).otherwise(F.try_divide(wrong_coverage, all_coverage))
    return stats.select(
        "model", "keyword", "wrong_question_count", "total_wrong",
        F.round(wrong_coverage, 6).alias("wrong_coverage"),
        "all_question_count", "all_total",
        F.round(all_coverage, 6).alias("all_coverage"),
        F.when(lift == float("inf"), lift).otherwise(F.round(lift, 6)).alias("lift"),
    )


def phrase_length(keyword: Column | str) -> Column:
    return F.size(F.split(as_column(keyword), " "))


def report_order() -> list[Column]:
    """Most wrong questions first, then longer phrases, higher lift, name."""
    return [
        F.desc("wrong_question_count"), F.desc("wrong_coverage"), phrase_length("keyword").desc(),
        F.desc("lift"), F.asc("keyword"),
    ]


def top_keywords(stats: DataFrame, k: int) -> DataFrame:
    return head_per_group(stats, ["model"], report_order(), k).withColumnRenamed("row_number", "rank")


def _parts(phrase: Column, longest: int) -> Column:
    """Every contiguous part of a phrase, itself left out."""
    words = F.split(phrase, " ")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        found = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.when(F.size(words) > n, found).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, longest)]))


def prune_nested(
    stats: DataFrame,
    found: DataFrame,
    wrong: DataFrame,
    keys: Sequence[str] = ("split", "id"),
    longest: int = 3,
    renamed: Sequence[str] = tuple(wl.PHRASE_ALIASES.values()),
    held: DataFrame | None = None,
) -> DataFrame:
    """Drop a phrase when a better-ranked phrase contains it and covers the same questions.

    Being part of a phrase and being covered by it are both transitive, so dropping by
    *any* better-ranked container equals walking the ranking and testing the kept ones.
    A question that holds a phrase holds its parts too, so the container covers the same
    questions exactly when both counts are equal, and having more words it is the better ranked
    then: the statistics without those that a phrase's parts name with its count, no question is
    looked at. Only a phrase that got its name from an alias may stand where its parts do not;
    those few, a fixed number per model, are counted per question.
    """
    # Smaller sorts first, so "better ranked" is a comparison of two structs.
    rank = F.struct(
        (-F.col("wrong_question_count")).alias("a"), (-F.col("wrong_coverage")).alias("b"),
        (-phrase_length("keyword")).alias("c"), (-F.col("lift")).alias("d"), F.col("keyword").alias("e"),
    )
    bound = max(longest, 2)
    aliases = F.col("keyword").isin(list(renamed))
    own = stats.where(~aliases).select(
        "model", "wrong_question_count", F.explode(_parts(F.col("keyword"), bound)).alias("keyword")
    ).distinct()
    kept = stats.join(own, ["model", "keyword", "wrong_question_count"], "left_anti")
    held = wrong_questions(found, wrong, keys) if held is None else held
    together = held.select(
        "models", "phrases", F.explode(F.array_intersect("phrases", tx.words(list(renamed)))).alias("container")
    )
    together = together.select(
        "models", "container", F.explode(F.array_intersect("phrases", _parts(F.col("container"), bound))).alias("keyword")
    )
    together = together.select(F.explode("models").alias("model"), "container", "keyword").groupBy(
        "model", "container", "keyword"
    ).agg(F.count("*").alias("both"))
    outer = stats.where(aliases).select("model", F.col("keyword").alias("container"), rank.alias("container_rank"))
    aliased = outer.join(F.broadcast(together), ["model", "container"])
    covered = stats.withColumn("rank", rank).join(F.broadcast(aliased), ["model", "keyword"]).where(
        (F.col("both") == F.col("wrong_question_count")) & (F.col("container_rank") < F.col("rank"))
    )
    return kept.join(F.broadcast(covered.select("model", "keyword").distinct()), ["model", "keyword"], "left_anti")


def keyword_links(
    top: DataFrame, found: DataFrame, wrong: DataFrame, questions: DataFrame, text: Column | str,
    keys: Sequence[str] = ("split", "id"), max_chars: int = 500, held: DataFrame | None = None,
) -> DataFrame:
    """One row per top keyword and wrong question holding it, with question details.

    ``max_chars`` is the length of the preview column of this report.
    """
    held = wrong_questions(found, wrong, keys) if held is None else held
    wanted = F.array_intersect("phrases", members(top, "keyword"))
    hits = held.select(*keys, F.explode_outer(wanted).alias("keyword"), "models").where("keyword IS NOT NULL")
    hits = hits.select(*keys, "keyword", F.explode("models").alias("model"))
    hits = hits.join(top.select("model", "keyword"), ["model", "keyword"], "left_semi")
    # Only questions that may be among them are moved.
    bits = code_bits(hits.select(_code(*keys)), QUESTION_PLACES)
    details = questions.where(maybe_held(_code(*keys), bits, QUESTION_PLACES)).select(
        *keys, "question_type", F.left(tx.collapse_spaces(text), F.lit(max_chars)).alias("question_preview")
    )
    return hits.join(details, list(keys), "left").withColumn("chapter", lb.split_chapter("split"))


def link_order() -> list[Column]:
    return [natural_key("model"), F.col("keyword"), natural_key("split"), natural_key("id")]
