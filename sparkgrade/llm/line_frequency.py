"""Quality rules: statistics of each text, and line frequency across documents of a host.

Lines are normalised (lower case, digit runs as 0, white space as one blank) and hashed.
For each host (``source``) and line the distinct documents holding it are counted; copies
of one text on one host are one document. Lines in more documents than the limit are
removed, and a document of which too little remains is rejected.

The statistics are one pass over the rows. Lines then travel as (host, text, line) hashes,
each once per text; counts are combined before the shuffle, so a line on every page of a
host is a sum like any other. Only lines over the absolute limit meet the host totals.

Defined cases: a NULL text has no words and fails; a NULL host is a host of its own; equal
rows each get a row; lines without a word are not counted; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrade.llm.common import only
from sparkgrade.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BLANK_RUN, DIGIT_RUN = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[0-9]+")
LEAST_WORDS, MOST_REPEATED = 50, 50
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list, run: int = 3) -> int:
    """Words inside windows of ``run`` words that the text holds twice or more."""
    if len(words) <= run:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    codes = ids[:len(ids) - run + 1]
    for i in range(1, run):
        codes = np.unique(codes, return_inverse=True)[1] if i > 1 and len(number) >= 1 << 20 else codes
        codes = codes * len(number) + ids[i:len(ids) - run + 1 + i]
    _, place, times = np.unique(codes, return_inverse=True, return_counts=True)
    inside, often = np.zeros(len(ids), bool), times[place] > 1
    for i in range(run):
        inside[i:i + len(often)] |= often
    return int(inside.sum())


def normal_line(line: str) -> str:
    return DIGIT_RUN.sub("0", BLANK_RUN.sub(" ", line.lower()).strip(" "))


def text_stats(text: str) -> tuple[list[int], dict[int, int]]:
    """The five statistics, and each normalised line's hash with the words its lines hold."""
    from xxhash import xxh64_intdigest

    words = text.encode().split()
    seen: set[str] = set()
    repeats, lines = 0, {}
    for line in text.split("\n"):
        if not line.strip(BLANKS):
            continue
        repeats += line in seen
        seen.add(line)
        value = xxh64_intdigest(normal_line(line).encode()) - (1 << 63)
        lines[value] = lines.get(value, 0) + len(line.encode().split())
    chars = len(text) - sum(map(text.count, BLANKS))
    return [len(words), chars, sum(map(text.count, SYMBOLS)), repeats, repeated_words(words)], lines


def statistics(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): the statistics, host and text hashes, lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, lines = [], []
            for value in batch["text"]:
                numbers, held = text_stats(value.as_py() or "")
                stats.append(numbers)
                lines.append([{"line": k, "words": n} for k, n in held.items()])
            columns = [pa.array(c, pa.int64()) for c in zip(*stats)] if stats else [pa.array([], pa.int64())] * len(STATS)
            kind = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["host"], batch["content"], *columns, pa.array(lines, kind)],
                ["doc_id", "host", "content", *STATS, "lines"],
            )

    given = only(docs, "doc_id", "text", "source").select(
        "doc_id", "text", F.xxhash64("source").alias("host"), F.xxhash64("text").alias("content"),
    )
    kind, numbers = given.schema["doc_id"].dataType.simpleString(), ", ".join(f"{s} bigint" for s in STATS)
    return given.mapInArrow(run, f"doc_id {kind}, host bigint, content bigint, {numbers}, lines array<struct<line: bigint, words: int>>")


def frequent_lines(lines: DataFrame, most_docs: int, most_share: float) -> DataFrame:
    """(host, line) of lines in more than ``most_docs`` documents of a host, and in more
    than ``most_share`` of them. ``lines``: one row (host, content, line) per text and line."""
    counts = lines.groupBy("host", "line").count().where(F.col("count") > most_docs)
    totals = lines.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    return counts.join(totals, "host").where(F.col("count") > F.col("docs") * most_share).select("host", "line")


def quality_rules(docs: DataFrame, most_docs: int = 10, most_share: float = 0.05, least_left: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, statistics, base_failed, left_words, kept.

    ``kept``: the base rules hold and at least ``least_left`` of the words stand in lines
    that are not removed.
    """
    stats = cut_lineage(statistics(docs), "line-stats")
    at = F.explode("lines").alias("at")
    lines = cut_lineage(stats.select("host", "content", at).select("host", "content", "at.line", "at.words").distinct(), "lines")
    frequent = cut_lineage(frequent_lines(lines, most_docs, most_share), "frequent-lines")
    removed = lines.join(frequent, ["host", "line"]).groupBy("host", "content").agg(F.sum("words").alias("removed"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    return stats.drop("lines").join(removed, ["host", "content"], "left").select(
        "doc_id", *STATS, failed.alias("base_failed"), left.alias("left_words"),
        (~failed & (left >= least_left * F.col("n_words"))).alias("kept"),
    )
