"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits, each the majority of that bit over the hashes of the text's
word shingles. If m groups of bits have thresholds t_1..t_m that add up to t - m + 1, two
fingerprints within t bits differ in at most t_i bits of some group i. Bits that go
together share a group; thresholds come from dynamic programming on the estimated number of
candidates; each fingerprint probes the values within t_i of its own in group i, and
the equi-join verifies the distance over all bits.

Copies collapse first: candidates are between distinct fingerprints. Only links that passed
the verification leave the join. Estimates steer cost alone; the links found are always all.

Defined cases: NULL and empty texts have fingerprint zero and link like any other; shorter
texts than a shingle give one shingle of all their words; NULL ids take part, and a
component's id is its least id that is not NULL; equal rows stay as many rows; other
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.llm.common import only, row_key
from sparkgrade.llm.components import components
from sparkgrade.session import cut_lineage

BITS = 64
SEED = 42
BLOCK = 65_536
PROBE_COST = 8.0
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    runs = zip(*[islice(words, i, None) for i in range(min(shingle, len(words)))])
    total, counts = max(1, len(words) - shingle + 1), np.zeros(BITS, np.int64)
    for done in range(0, total, BLOCK):
        size = min(BLOCK, total - done)
        hashes = np.fromiter((xxh64_intdigest(b" ".join(r), SEED) for r in islice(runs, size)), ">u8", size)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(size, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, key (of the row's content), fp (the fingerprint as a signed BIGINT), one row per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py() or "", shingle) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(values.view(np.int64))], ["doc_id", "key", "fp"])

    docs = only(docs, "doc_id", "text").withColumn("key", row_key("doc_id", "text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key bigint, fp bigint")


def bit_table(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both set (all rows count)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            values = batch["fp"].to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1).astype(np.float32)
            both += np.rint(bits.T @ bits).astype(np.int64)
            total += len(bits)
        sums = np.concatenate([both.ravel(), [total]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["at", "n"])

    parts = nodes.select("fp").mapInArrow(run, "at bigint, n bigint")
    sums = np.zeros(BITS * BITS + 1, np.int64)
    for row in parts.groupBy("at").agg(F.sum("n").alias("n")).collect():
        sums[row["at"]] = row["n"]
    return int(sums[-1]), sums[:-1].reshape(BITS, BITS)


def correlated_groups(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0 = highest) in ``parts`` groups of nearly equal size, correlated bits together."""
    p = np.diag(both) / max(1, total)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    rho = np.abs((both / max(1, total) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(rho, 0)
    free, groups = set(range(BITS)), []
    for i in range(parts):
        size = (BITS * (i + 1)) // parts - (BITS * i) // parts
        order = sorted(free)
        group = [max(order, key=lambda b: rho[b, order].sum())]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: rho[b, group].sum()))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def pair_share(total: int, both: np.ndarray, group: list[int], radius: int) -> float:
    """Estimated share of pairs within ``radius`` bits on a group: bits differ with 2p(1-p),
    as many of them independent as their correlations leave."""
    p = np.diag(both)[group] / max(1, total)
    differ = np.clip(2 * p * (1 - p), 1e-6, 1 - 1e-6)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    rho = np.abs((both[np.ix_(group, group)] / max(1, total) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(rho, 1)
    free = len(group) ** 2 / max(rho.sum(), len(group)) / len(group)
    counts = np.zeros(radius + 1)
    counts[0] = 1
    for d in differ:
        counts[1:] = counts[1:] * (1 - d) + counts[:-1] * d
        counts[0] *= 1 - d
    return float(counts.sum()) ** free


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 (-1: group not probed) of sum ``total`` at least cost;
    ``costs[i][t + 1]`` is the cost of threshold t in group i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, chosen) in best.items():
            for at, price in enumerate(cost):
                key, found = used + at - 1, (spent + price, [*chosen, at - 1])
                if key not in step or found < step[key]:
                    step[key] = found
        best = step
    return best[total]


def probing_plan(total: int, both: np.ndarray, threshold: int) -> list[tuple[list[int], int]]:
    """The groups to probe with their thresholds, cheapest over the numbers of groups."""
    found = []
    for parts in range(1, threshold + 2):
        groups = correlated_groups(total, both, parts)
        costs = []
        for group in groups:
            cost = [0.0]
            for radius in range(threshold + 1):
                probes = ball(len(group), radius)
                cost.append(total * (PROBE_COST * probes + total * pair_share(total, both, group, radius)))
            costs.append(cost)
        price, radii = allocate(costs, threshold - parts + 1)
        found.append((price, parts, [(g, r) for g, r in zip(groups, radii) if r >= 0]))
    return min(found)[2]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def around(part: int, value: Column, masks: list[int]) -> Column:
    """(part, value) for a group's value under each mask."""
    return F.transform(
        F.array(*[F.lit(m) for m in masks]),
        lambda mask: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(mask).alias("value")),
    )


def near_links(nodes: DataFrame, threshold: int = 3) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints ``nodes`` (fp) within ``threshold`` bits."""
    total, both = bit_table(nodes)
    index, probes = [], []
    for part, (group, radius) in enumerate(probing_plan(total, both, threshold)):
        bits = [1 << (BITS - 1 - b) for b in group]
        masks = [signed(sum(c)) for r in range(radius + 1) for c in combinations(bits, r)]
        value = F.col("fp").bitwiseAND(F.lit(signed(sum(bits))))
        index.append(F.struct(F.lit(part).alias("part"), value.alias("value")))
        probes.append(around(part, value, masks))
    held = nodes.select(F.col("fp").alias("a"), F.explode(F.array(*index)).alias("at")).select("a", "at.part", "at.value")
    asked = nodes.select(F.col("fp").alias("b"), F.explode(F.concat(*probes)).alias("at")).select("b", "at.part", "at.value")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    on = (held["part"] == asked["part"]) & (held["value"] == asked["value"]) & (F.col("a") < F.col("b")) & near
    return held.join(asked, on).select("a", "b")


def classes(prints: DataFrame, threshold: int) -> DataFrame:
    """fp, root (one for each class) and component_id for every distinct fingerprint."""
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    labels = components(near_links(nodes.select("fp"), threshold))
    rooted = nodes.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"),
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits),
    component_id (the least doc_id reachable over links of at most ``threshold`` bits)."""
    prints = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    return prints.join(classes(prints, threshold), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
    )


def one_of_each(docs: DataFrame, shingle: int = 3, threshold: int = 3) -> DataFrame:
    """``docs`` with one row of each class: that of its least id (and of the least content
    key, where rows share that id or a class has NULL ids only)."""
    prints = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    first = prints.join(classes(prints, threshold), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = cut_lineage(first.groupBy("root").agg(F.min("key").alias("_key")).select("_key"), "kept")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), row_key("doc_id", "text").alias("_key"))
    return rows.join(kept, "_key").dropDuplicates(["_key"]).select("doc.*")
