"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_process(key: Any, make: Callable[[], Any]) -> Any:
    """``make()`` once per Python worker, so tasks of one worker share models and caches. A
    worker holds one such model at a time: Spark keeps its workers from stage to stage."""
    store = sys.__dict__.setdefault("_sparkgrade_llm", {})
    if key not in store:
        drop_models()
        store[key] = make()
    return store[key]


def drop_models() -> None:
    """Free what an earlier operator's tasks left in this Python worker."""
    store = sys.__dict__.setdefault("_sparkgrade_llm", {})
    if store:
        store.clear()
        gc.collect()


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns: columns beside them can't clash with an operator's own."""
    return df.select(*[df[n] for n in names])


def whole(column: str = "text") -> Column:
    """The text with NULL as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(*columns: str) -> Column:
    """A content key; equal rows share it and get equal verdicts, rows of one id differ by text."""
    return F.xxhash64(*[F.col(c) for c in columns])


class BoundedCache(dict):
    """Word -> value; a missing word is computed, and the cache starts anew at its size limit."""

    def __init__(self, make: Callable[[str], Any], limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: str) -> Any:
        if len(self) >= self.limit:
            self.clear()
        value = self.make(word)
        if len(word) <= 64:
            self[word] = value
        return value


def by_size(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``most`` bytes of text each, so that what a task holds at once
    is bounded by bytes, not by rows; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        parts = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string")) % modulus


def hash_sample(df: DataFrame, column: str, most: int) -> DataFrame:
    """About ``most`` rows (all, if there are no more), chosen by the hash of ``column``."""
    total = df.count()
    if total <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), column), F.lit(1 << 20)) < int(most / total * (1 << 20)) + 1)
