"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrade.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> one row per linked node: node, root (any one node of its component).

    Each round every node moves to the neighbour (or itself) whose hash of this round is
    least, which joins about half of the nodes to another; links are rewritten between the
    nodes moved to, and loops and repeats go. Moves are minima, combined before the shuffle;
    no neighbourhood is gathered, and a hub costs no more than its links. Rounds grow with
    the logarithm of the largest component. Every round is written to the shared folder.
    """
    links = cut_lineage(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "links",
    )
    labels = None
    salt = 0
    while not links.isEmpty():
        salt += 1

        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank, own = F.xxhash64(F.lit(salt), "b"), F.xxhash64(F.lit(salt), "a")
        best = both.groupBy("a").agg(F.min_by("b", rank).alias("to"), F.min(rank).alias("rank"))
        root = F.when(own <= F.col("rank"), F.col("a")).otherwise(F.col("to"))
        moves = cut_lineage(best.select(F.col("a").alias("node"), root.alias("root")), "moves")
        if labels is None:
            labels = moves
        else:
            step = moves.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = cut_lineage(
                labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels",
            )
        left = moves.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = moves.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = links.join(left, "a").join(right, "b").where("ra != rb")
        links = cut_lineage(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
