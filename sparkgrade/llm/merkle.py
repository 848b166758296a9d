"""Merkle manifest of a dataset: subtrees are exchanged by superblock, proofs joined and folded.

Every row is a leaf: the SHA-256 of its fields. Per source the leaves ascend by id; 16
neighbours become one node, level by level, up to a subroot; the subroots, by source, become
the root in the same way. Digests are hashed as hex text, one after the other.

A superblock is a run of 16^3 leaves of one source. Leaves are hashed where they lie and
travel as digests. Their positions come from a range-partitioned order: counts a slice and
source give the offsets, so the leaves of a hot source are ordered by many tasks.

* ``reduced`` turns each superblock into the node three levels up; these nodes, a 4096th of
  the rows, are climbed in the same way until one a source is left, and so are the subroots.
  ``climb`` keeps for each node its trail: the siblings before and behind it at each level.
* ``manifest`` cogroups leaves and the required outer nodes (the superblock's trail to the
  root) by superblock in ``applyInPandas``: one call reduces the superblock locally, joins
  inner and outer siblings into proofs, and folds every leaf up to the root again.

A call holds the superblocks of one hash bin, about 4096 rows in all, never a source; many
small sources share a bin. Nothing but row counts reaches the driver.

Defined cases: NULL fields are written ``-``; a NULL source comes first; NULL ids come first
in their source and are never tampered; rows of equal source and id follow one another by
leaf; equal rows are leaves of their own; no rows give no manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrade.llm.common import only
from sparkgrade.operators.keys import global_rank
from sparkgrade.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, DEPTH = 16, 3
SPAN = FAN ** DEPTH
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRAIL = "array<struct<before: string, behind: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(text: Column) -> Column:
    """The leaf of a row whose text is ``text``."""
    fields = [F.col(f).cast("string") for f in FIELDS[:-1]] + [text]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ladder(nodes: list[str], total: int) -> list[list[str]]:
    """The levels above a run of nodes: up to one node if they are the whole tree of ``total``
    nodes, else the three levels that a superblock spans."""
    levels = [nodes]
    while len(levels) <= DEPTH if total > SPAN else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i:i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def runs(levels: list[list[str]]) -> list[list[str]]:
    """For each level but the last, the joined digests of each run of 16."""
    return [["".join(level[i:i + FAN]) for i in range(0, len(level), FAN)] for level in levels[:-1]]


def siblings(joined: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """What stands before and behind the node at ``at`` in its run, level by level."""
    for level in joined:
        run, cut = level[at // FAN], at % FAN * 64
        yield run[:cut], run[cut + 64:]
        at //= FAN


def binned(nodes: DataFrame, rows: int) -> DataFrame:
    """``nodes`` (owner, pos, ...) with their superblock, and a bin of whole superblocks."""
    block = F.expr(f"pos div {SPAN}")
    return nodes.withColumn("block", block).withColumn("bin", F.pmod(F.xxhash64("owner", "block"), F.lit(max(1, rows // SPAN))))


def each_block(rows: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
    for key, block in rows.groupby(["owner", "block"], sort=False):
        yield key, block.sort_values("pos", kind="stable")


def reduced(nodes: DataFrame, rows: int) -> DataFrame:
    """One row per superblock of ``nodes`` (owner, pos, total, digest): the node that closes it,
    as a node of the next tree."""
    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (owner, block), part in each_block(group):
            total = int(part["total"].iloc[0])
            out.append((owner, block, -(-total // SPAN), ladder(part["digest"].tolist(), total)[-1][0]))
        return pd.DataFrame(out, columns=["owner", "pos", "total", "digest"])

    given = binned(nodes.select("owner", "pos", "total", "digest"), rows)
    return given.groupBy("bin").applyInPandas(reduce, "owner string, pos long, total long, digest string")


def climb(nodes: DataFrame) -> DataFrame:
    """``nodes`` (owner, pos, total, digest) with the trail to their tree's root, and the root."""
    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (owner, block), part in each_block(group):
            total = int(part["total"].iloc[0])
            levels = ladder(part["digest"].tolist(), total)
            joined = runs(levels)
            for i, pos in enumerate(part["pos"].tolist()):
                trail = [{"before": a, "behind": b} for a, b in siblings(joined, i)]
                out.append((owner, pos, block, -(-total // SPAN), trail, levels[-1][0]))
        return pd.DataFrame(out, columns=["owner", "pos", "block", "next", "trail", "top"])

    rows = nodes.count()
    done = binned(nodes.select("owner", "pos", "total", "digest"), rows).groupBy("bin").applyInPandas(
        reduce, f"owner string, pos long, block long, next long, trail {TRAIL}, top string")
    done = cut_lineage(done, "climb")
    if (done.agg(F.max("next")).first()[0] or 1) == 1:
        return done.select("owner", "pos", "trail", F.col("top").alias("root"))
    above = climb(done.where(F.col("pos") == F.col("block") * SPAN).select(
        "owner", F.col("block").alias("pos"), F.col("next").alias("total"), F.col("top").alias("digest")))
    above = above.select("owner", F.col("pos").alias("block"), F.col("trail").alias("more"), "root")
    return done.join(above, ["owner", "block"]).select("owner", "pos", F.concat("trail", "more").alias("trail"), "root")


def ordered_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves (id, owner, leaf, other, pos, total): ``other`` is the leaf of the tampered row;
    ``owner`` is the source, written so that NULL sorts first and is no other source."""
    owner = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("")).alias("owner")
    text = F.col("text")
    other = F.when(tampered, leaf(lowered(text))).otherwise(leaf(text))
    order = [F.col("owner"), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    leaves = only(docs, *FIELDS).select("doc_id", owner, leaf(text).alias("leaf"), other.alias("other"))
    placed = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    # A NULL id would turn the ids of its group into floats in pandas, so they travel as text.
    placed = cut_lineage(placed.withColumn("doc_id", F.col("doc_id").cast("string")), "leaves")
    placed = placed.withColumn("slice", F.shiftright("place", 33)).withColumn("inside", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))

    # One row a slice and source: how many leaves, and where in the slice they begin.
    counts = cut_lineage(placed.groupBy("slice", "owner").agg(F.count("*").alias("rows"), F.min("inside").alias("first")), "slices")
    earlier = Window.partitionBy("owner").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("owner").agg(F.sum("rows").alias("total"))
    shift = (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift")
    known = counts.select("slice", "owner", shift).join(totals, "owner")
    return placed.join(known, ["slice", "owner"]).select("doc_id", "owner", "leaf", "other", (F.col("inside") + F.col("shift")).alias("pos"), "total")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text): its leaf, subroot, the
    root and the digest of its proof, all of the rows as they are; ``folded_root`` from the
    row as ``tampered`` (a condition; default: none) changes it, and ``verified``."""
    changed = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaves = cut_lineage(ordered_leaves(docs, changed), "positions")
    rows = leaves.count()
    tops = cut_lineage(reduced(leaves.withColumnRenamed("leaf", "digest"), rows), "superblocks")
    inner = cut_lineage(climb(tops), "subtrees").withColumnRenamed("root", "subroot")

    subroots = inner.where("pos = 0").select("owner", F.col("subroot").alias("digest"))
    numbered = cut_lineage(global_rank(subroots, ["owner"]), "subroots")
    sources = numbered.select("owner", (F.col("rank") - 1).alias("at"))
    upper = climb(numbered.select(F.lit("").alias("owner"), (F.col("rank") - 1).alias("pos"), F.lit(numbered.count()).alias("total"), "digest"))
    upper = upper.select(F.col("pos").alias("at"), F.col("trail").alias("more"), "root")
    outer = inner.join(sources.join(upper, "at"), "owner").select(
        "owner", F.col("pos").alias("block"), F.concat("trail", "more").alias("trail"), "subroot", "root")
    outer = outer.withColumn("bin", F.pmod(F.xxhash64("owner", "block"), F.lit(max(1, rows // SPAN))))

    def finish(group: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        known = {(o, b): (t, s, r) for o, b, t, s, r in nodes[["owner", "block", "trail", "subroot", "root"]].itertuples(index=False)}
        out = []
        for key, part in each_block(group):
            trail, subroot, root = known[key]
            outside = [(t["before"], t["behind"]) for t in trail]
            rest = "".join(a + b for a, b in outside)
            joined = runs(ladder(part["leaf"].tolist(), int(part["total"].iloc[0])))
            for i, (doc_id, own, other) in enumerate(part[["doc_id", "leaf", "other"]].itertuples(index=False)):
                inside = list(siblings(joined, i))
                proof = digest("".join(a + b for a, b in inside) + rest)
                node = other
                for before, behind in (*inside, *outside):
                    node = digest(before + node + behind)
                out.append((doc_id, own, subroot, root, proof, node))
        return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    done = binned(leaves, rows).groupBy("bin").cogroup(outer.groupBy("bin")).applyInPandas(
        finish, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    kind = docs.schema["doc_id"].dataType
    return done.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("verified", F.col("folded_root") == F.col("root"))


def audit(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """The manifest checked against rows of which those whose id's crc32 ``modulus`` divides
    have a lower-cased text."""
    return manifest(docs, F.crc32(F.col("doc_id").cast("string")) % modulus == 0)
