"""Sort keys: natural order of ids, chapter order, group order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.functions.text import as_column


def natural_key(text: Column | str) -> Column:
    """Text under which ``1.2 < 1.10 < 10.1``; words compare in lower case.

    Each run of digits is written as its digit count and its digits, so plain text order
    is numeric order for runs of any length; a zero byte ends each word, so a shorter
    word sorts first. Sort by a column that holds the key, not by the expression: a sort
    would compute it again for every comparison (see ``sort_by_keys``).
    """
    def written(piece: Column) -> Column:
        number = F.ltrim(F.regexp_extract(piece, r"\d*$", 0), F.lit("0"))
        count = F.lpad(F.length(number).cast("string"), 10, "0")
        word = F.rtrim(piece, F.lit("0123456789"))
        has_number = F.length(word) < F.length(piece)
        return F.concat(word, F.lit("\u0000"), F.when(has_number, F.concat(count, number)).otherwise(""))

    pieces = F.regexp_extract_all(F.lower(as_column(text)), F.lit(r"\D+\d*|\d+"), F.lit(0))
    return F.array_join(F.transform(pieces, written), "")


def sort_by_keys(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Sort by key expressions, each computed once per row."""
    named = {f"_sort{i}": as_column(key) for i, key in enumerate(keys)}
    return df.withColumns(named).orderBy(*named).drop(*named)


def chapter_key(split: Column | str) -> Column:
    """Introduction first, numbered chapters by number, everything else last by name."""
    split = as_column(split)
    number = F.regexp_extract(split, r"^chapter_(\d+)$", 1).try_cast("int")
    rank = F.when(split == "chapter_intro", -1).otherwise(F.coalesce(number, F.lit(9999)))
    return F.struct(rank.alias("rank"), split.alias("name"))


def group_key(group: Column | str) -> Column:
    """Numeric groups by value, then the others by name."""
    number = as_column(group).try_cast("bigint")
    return F.struct(number.isNull().alias("is_text"), number.alias("number"), as_column(group).alias("name"))


def seeded_key(seed: int, *columns: Column | str) -> Column:
    """Pseudo-random order that does not depend on how rows are partitioned."""
    return F.xxhash64(*[as_column(c) for c in columns], F.lit(seed))
