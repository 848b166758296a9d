"""Audit of filters that overlap: what each removes in every order, alone, and for nothing.

Five filters judge whole texts: A few words, B repeated words, C capitals, D symbols, and E
copies of a text with a smaller id. A to D are column expressions. E has a prepass: every
task folds the 64-bit hashes of its texts into a counting Bloom sketch, four cells a text in
one block of 4096, counts ending at two; the sketches are merged block by block. A text one
of whose cells counts one is unique. Only possible repeats, text and all, are grouped by
their text for the least id; copies are combined before that shuffle.

Flags, labels and copies then meet as small rows by id, and are added up to counts per part
and mask of failed filters, 32 masks a part. All orders and steps follow from these counts.

The sketch has 16 cells a row and keeps one bit a cell after merging. Up to ``MOST_BLOCKS``
blocks (32 MB) it is broadcast, a size known beforehand; beyond, it is joined by block.

Defined cases: a NULL text is the empty text; a NULL lang is the part ``''``; a row with a
NULL id has no label and is neither a copy nor makes one; rows that share id and text do not make
one another copies; an id labelled twice is good or toxic if one of the labels says so; equal
rows count twice; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.llm.common import only, whole
from sparkgrade.session import cut_lineage

FILTERS = "ABCDE"
CELLS, CELLS_A_ROW = 4096, 16
# Blocks of 4096 bits: 32 MB in all.
MOST_BLOCKS = 1 << 16
# Blocks that one call merges, cells that a task folds at once, and where a cell stands in 64 bits.
BAND, MOST_CELLS, SHIFTS = 64, 1 << 21, (4, 18, 32, 46)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def flags(text: Column) -> Column:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    without = lambda characters: F.length(F.translate(text, characters, "")).cast("long")
    size = F.length(text).cast("long")
    failed = [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        100 * (size - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) > 10 * size,
        without("#$%&*|") < size,
    ]
    return reduce(Column.__add__, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)])


def places(mixed: np.ndarray) -> np.ndarray:
    """The four cells of each text within its block."""
    return np.stack([mixed >> s & (CELLS - 1) for s in SHIFTS], 1)


def sketch(texts: DataFrame) -> DataFrame:
    """(block, often) of ``texts`` (block, mixed): for each block the cells that count two or
    more, as 64 words of 64 bits."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for batch in batches:
            block, mixed = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "mixed"))
            seen.append((block[:, None] * CELLS + places(mixed)).ravel())
            if sum(map(len, seen)) > MOST_CELLS:
                yield from written(np.concatenate(seen))
                seen = []
        if seen:
            yield from written(np.concatenate(seen))

    def written(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Each cell once, as twice its place in the block, and one more from two counts on."""
        cell, times = np.unique(cells, return_counts=True)
        block = cell // CELLS
        at = np.flatnonzero(np.diff(block, prepend=-1))
        inner = pa.array(cell % CELLS * 2 + (times > 1), pa.int16())
        held = pa.ListArray.from_arrays(pa.array(np.append(at, len(cell)), pa.int32()), inner)
        yield pa.RecordBatch.from_arrays([pa.array(block[at] // BAND, pa.int32()), pa.array(block[at], pa.int32()), held], ["band", "block", "cells"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, rows in part.groupby("block")["cells"]:
            entries = np.concatenate(rows.tolist()).astype(np.int64)
            counts = np.bincount(entries // 2, weights=1 + entries % 2, minlength=CELLS)
            out.append((block, np.packbits(counts > 1, bitorder="little").view("<i8")))
        return pd.DataFrame(out, columns=["block", "often"])

    pieces = texts.select("block", "mixed").mapInArrow(fold, "band int, block int, cells array<short>")
    return pieces.groupBy("band").applyInPandas(merge, "block int, often array<bigint>")


def probed(texts: DataFrame, often: DataFrame, blocks: int) -> DataFrame:
    """``texts`` (block, mixed, ...) with ``maybe``: all four cells count two or more."""
    if blocks <= MOST_BLOCKS:
        often = F.broadcast(often)
    maybe = F.lit(True)
    for s in SHIFTS:
        cell = F.shiftright("mixed", s).bitwiseAND(F.lit(CELLS - 1)).cast("int")
        maybe = maybe & (F.getbit(F.get("often", F.shiftright(cell, 6)), cell.bitwiseAND(F.lit(63))) == 1)
    return texts.join(often, "block", "left").withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("often", "block")


def failures(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, part and the mask of failed filters."""
    given = only(docs, "doc_id", "text", "lang").select("doc_id", whole().alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    hashed = given.withColumn("hash", F.xxhash64("text")).withColumn("mixed", F.xxhash64(F.lit(1), "hash"))
    facts = cut_lineage(hashed.select("doc_id", "part", "hash", "mixed", flags(F.col("text")).alias("mask")), "facts")

    blocks = facts.count() * CELLS_A_ROW // CELLS + 1
    block = F.pmod("hash", F.lit(blocks)).cast("int").alias("block")
    often = cut_lineage(sketch(facts.where("doc_id IS NOT NULL").select(block, "mixed")), "sketch")
    texts = hashed.where("doc_id IS NOT NULL").select("doc_id", "text", "mixed", block)
    first = probed(texts, often, blocks).where("maybe").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    first = cut_lineage(first.select("doc_id", F.xxhash64("text").alias("hash"), F.lit(True).alias("first")), "first-copies")

    # A possible repeat that is not the first of its text is a copy.
    flagged = probed(facts.select("*", block), often, blocks).join(first, ["doc_id", "hash"], "left")
    copy = F.col("maybe") & F.col("first").isNull() & F.col("doc_id").isNotNull()
    return flagged.select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents that fail exactly the filters of a mask."""
    marked = only(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failures(docs).join(marked, "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of the step's filter."""
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = ", ".join(f"('{o}', {i + 1}, {bits[f]}, {sum(bits[g] for g in o[:i])})" for o in ORDERS for i, f in enumerate(o))
    counts = cut_lineage(mask_counts(docs, labels), "mask-counts")
    at = counts.selectExpr("*", f"inline(array({steps})) AS (filter_order, step, own, before)")
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    added = {
        "kept": (~fails & ~earlier, F.col("n")), "removed": (fails & ~earlier, F.col("n")), "redundant": (fails & earlier, F.col("n")),
        "unique_fails": (F.col("mask") == F.col("own"), F.col("n")), "good_lost": (fails & ~earlier, F.col("good")),
        "toxic_lost": (fails & ~earlier, F.col("toxic")),
        # Of all orders, one in as many as a mask has filters puts this filter before the others.
        "shapley": (fails, F.col("n") * F.expr(f"{len(ORDERS)} div bit_count(mask)")),
    }
    sums = [F.sum(F.when(condition, value).otherwise(0)).alias(name) for name, (condition, value) in added.items()]
    return at.groupBy("part", "filter_order", "step").agg(*sums)
