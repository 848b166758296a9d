"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes a template: numbers, names (capitalised words inside a sentence) and units
after numbers turn into typed placeholders, the rest is lower-cased and loses the
punctuation at its words' edges. White space stays, so template and raw words align.
A capitalised word that opens a sentence may be a name or not, so windows with openers count
in both forms, with openers as words and as names, and slot consistency decides.
Windows of five template words are joined by hash with those of the benchmark. Matches on
one diagonal must be consistent in their slots: each value of the item stands for one value
of the document and the other way round. A document holds an item if matches on consistent
diagonals cover at least 0.8 of the item's windows; it may do so with other parameters.

Documents pass once through a scan, a generator and a bitmap of the benchmark's codes; only
windows that may match go on to the hash join, with five raw words each. Whether the benchmark's
windows are broadcast is Spark's choice by their written size. What is shuffled besides are
matches, by (document, item, diagonal), so that a passage that many documents hold is spread.

Defined cases: NULL and empty texts hold nothing; items of fewer than five words, or whose
windows are placeholders only, are never found; equal rows are found equally; NULL ids are
kept; other columns travel in ``doc`` and cannot clash; an empty benchmark finds nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.llm.common import row_key, whole
from sparkgrade.session import cut_lineage

WINDOW = 5
COVERED = 0.8
LITERALS = 2
# Bits of the bitmap through which windows of documents go before they are joined.
CODES = 1 << 18
NAME, NUMBER, UNIT, OPENER = "\ue000", "\ue001", "\ue002", "\ue003"
# Units of measure that a number may carry.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ml cl l liter liters litre "
    "litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year "
    "years km/h mph m/s hz khz mhz ghz w kw mw kwh v a j kj n pa bar k °c °f % percent dollar dollars euro euros pound "
    "pounds cent cents eur usd gbp kb mb gb tb"
).split()
WORD = r"[^\x20\x09-\x0D]+"
PLACE = f"[{NAME}{NUMBER}{UNIT}]"
# Each begins with what it replaces and looks back from there, which fails fastest.
NAMED = r"\p{Lu}(?<=[\p{L}\p{N},]\x20\p{Lu})[\p{L}'’-]*"
# What NAMED leaves: capitalised words that open a sentence, a line, a quotation or the text.
OPENING = r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})[\p{L}'’-]*"
OPENED = rf"{OPENER}[\p{{L}}'’-]*"
NUMBERED = r"(?:[+-]\p{N}|\p{N})(?<![\p{L}\p{N}][+-]?\p{N})\p{N}*(?:[.,:/]\p{N}+)*(?![\p{L}\p{N}])"
INSIDE, BLANK = rf"[\p{{L}}\p{{N}}{NAME}{NUMBER}{UNIT}{OPENER}]", r"[\x20\x09-\x0D]"
EDGES = rf"\p{{Punct}}(?:(?<={INSIDE}\p{{Punct}})\p{{Punct}}*+(?={BLANK}|$)|(?<=(?:^|{BLANK})\p{{Punct}})\p{{Punct}}*+(?={INSIDE}))"


def template(text: Column) -> Column:
    """The canonical text, word for word beside the raw one; OPENER stands before sentence openers."""
    units = "|".join(sorted((u.replace("/", r"\/") for u in UNITS), key=lambda u: (-len(u), u)))
    named = F.regexp_replace(F.regexp_replace(text, NAMED, NAME), OPENING, f"{OPENER}$0")
    numbered = F.lower(F.regexp_replace(named, NUMBERED, NUMBER))
    measured = F.regexp_replace(numbered, rf"{NUMBER}(\x20?)(?:{units})(?![\p{{L}}\p{{N}}])", rf"{NUMBER}$1{UNIT}")
    return F.regexp_replace(measured, EDGES, "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def windows(rows: DataFrame, *keep: str, bits: Column | None = None) -> DataFrame:
    """``keep``, raw, made, named (the words, with openers as words and as names), pos, code,
    opened: one row per window of ``_text``, and another with the openers as names if it has any;
    with ``bits`` only those whose code the bitmap may hold. Rows carry all words of their text, so
    the windows are thinned inside the array, before they become rows."""
    split = rows.select(*keep, words(F.col("_text")).alias("raw"), words(template(F.col("_text"))).alias("marked"))
    as_word = lambda w: F.replace(w, F.lit(OPENER), F.lit(""))
    as_name = lambda w: F.when(w.contains(OPENER), F.regexp_replace(w, OPENED, NAME)).otherwise(w)
    made = split.select(
        *keep, "raw", F.transform("marked", as_word).alias("made"), F.transform("marked", as_name).alias("named"),
        # Each word is hashed once, a window's code is that of its five hashes.
        F.transform("marked", lambda w: F.xxhash64(as_word(w))).alias("word_codes"),
        F.filter(F.transform("marked", lambda w, i: F.when(w.contains(OPENER), i + 1)), lambda i: i.isNotNull()).alias("opens"),
        F.transform("marked", lambda w: F.xxhash64(as_name(w))).alias("name_codes"),
    )
    last = F.size("word_codes") - WINDOW + 1

    def coded(given: str, starts: Column, opened: bool) -> Column:
        def window(i: Column) -> Column:
            return F.struct((i - 1).alias("pos"), F.xxhash64(F.slice(given, i, F.lit(WINDOW))).alias("code"), F.lit(opened).alias("opened"))

        return F.transform(starts, window)

    # The windows around an opener, from the openers' places: few words are openers.
    around = F.flatten(F.transform("opens", lambda i: F.filter(F.sequence(i - WINDOW + 1, i), lambda j: (j > 0) & (j <= last))))
    both = F.when(last > 0, F.concat(coded("word_codes", F.sequence(F.lit(1), last), False), coded("name_codes", F.array_distinct(around), True)))
    if bits is not None:
        both = F.filter(both, lambda z: maybe_held(z["code"], bits))
    return made.select(*keep, "raw", "made", "named", F.explode(both).alias("_at")).select(*keep, "raw", "made", "named", "_at.*")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, windows (their number), at (place), code, as_name (openers as names), shown and
    meant (raw and template words)."""
    items = windows(benchmark.select("item_id", whole().alias("_text")), "item_id")
    meant = F.slice(F.when(F.col("opened"), F.col("named")).otherwise(F.col("made")), F.col("pos") + 1, WINDOW)
    literal = F.size(F.filter("meant", lambda w: ~w.rlike(PLACE)))
    found = items.select(
        "item_id", F.col("pos").alias("at"), "code", F.col("opened").alias("as_name"), F.slice("raw", F.col("pos") + 1, WINDOW).alias("shown"), meant.alias("meant"),
    )
    kept = found.where(literal >= LITERALS)
    totals = kept.groupBy("item_id").agg(F.countDistinct("at").alias("windows"))
    return kept.join(totals, "item_id")


def code_bits(items: DataFrame) -> Column:
    """A bitmap of the windows' codes, 32 KB whatever their number, as a constant array."""
    word, bit = (F.col("code").bitwiseAND(F.lit(CODES - 1)) / 64).cast("int"), F.expr("shiftleft(1L, cast(code & 63 AS int))")
    held = items.select(word.alias("id"), bit.alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    whole_ = items.sparkSession.range(CODES // 64).join(held, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("id", "bits")))
    bits = whole_.agg(F.transform(ordered, lambda z: z["bits"])).first()[0]
    return F.from_json(F.lit(json.dumps(bits)), "array<bigint>")


def maybe_held(code: Column, bits: Column) -> Column:
    at = code.bitwiseAND(F.lit(CODES - 1))
    return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^\p{Punct}+|\p{Punct}+$", ""))


def slots(meant: Column, shown: Column, raw: Column) -> Column:
    """(type, item's value, document's value) of a window's placeholders."""
    placed = F.filter(F.arrays_zip(meant.alias("m"), shown.alias("s"), raw.alias("r")), lambda z: z["m"].rlike(PLACE))
    return F.transform(placed, lambda z: F.struct(z["m"].alias("m"), bare(z["s"]).alias("s"), bare(z["r"]).alias("r")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, _key (content key of the row), item_id, matched, windows, first_word, reworked
    (some slot has another value): one row per distinct row of ``docs`` and item that it holds."""
    # Few files, so that the written size, by which Spark decides on a broadcast, is the data's.
    items = cut_lineage(benchmark_windows(benchmark).coalesce(4), "benchmark-windows")
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("_key"), whole().alias("_text"))
    # Only windows that may match leave the rows' own task, with their five raw words.
    hits = windows(rows, "doc_id", "_key", bits=code_bits(items)).select(
        "doc_id", "_key", "pos", "code", "opened", F.slice("raw", F.col("pos") + 1, WINDOW).alias("raw"))
    found = hits.join(items, "code").select(
        "doc_id", "_key", "item_id", "windows", "at", "pos", (F.col("opened") | F.col("as_name")).alias("opened"),
        slots(F.col("meant"), F.col("shown"), F.col("raw")).alias("slots"),
    )

    def variant(words_only: bool) -> Column:
        at, pairs, first = (F.when(~F.col("opened"), c) if words_only else c for c in (F.col("at"), F.col("slots"), F.col("pos")))
        return F.struct(F.collect_set(at).alias("at"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"), F.min(first).alias("first"))

    # With openers as words only, and with all; the one may be consistent where the other is not.
    diagonals = found.groupBy("doc_id", "_key", "item_id", "windows", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.array(variant(True), variant(False)).alias("variants"),
    ).select("doc_id", "_key", "item_id", "windows", F.explode("variants").alias("_v")).select("doc_id", "_key", "item_id", "windows", "_v.*").where(F.size("at") > 0)
    pairs = F.size("slots")
    mapped = F.size(F.array_distinct(F.transform("slots", lambda z: F.struct(z["m"], z["s"]))))
    back = F.size(F.array_distinct(F.transform("slots", lambda z: F.struct(z["m"], z["r"]))))
    other = F.exists("slots", lambda z: z["s"] != z["r"])
    consistent = diagonals.where((pairs == mapped) & (pairs == back)).select("*", other.alias("other"))
    covered = consistent.groupBy("doc_id", "_key", "item_id", "windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("matched"),
        F.min("first").alias("first_word"), F.max("other").alias("reworked"),
    )
    return covered.where(F.col("matched") >= COVERED * F.col("windows"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated documents with the items they hold."""
    return contaminated(docs, benchmark).select(
        "doc_id", "item_id", F.col("matched").cast("long").alias("matched"), "windows", "first_word", "reworked",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    held = cut_lineage(contaminated(docs, benchmark).select("_key").distinct(), "contaminated")
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), row_key("doc_id", "text").alias("_key"))
    return kept.join(held, "_key", "left_anti").select("doc.*")
