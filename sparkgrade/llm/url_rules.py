"""URL filters by a sort-merge range join, in DataFrame functions only.

A host is written as its reversed labels (``blog.example.net`` as ``net.example.blog.``), so
a rule's host and all its subdomains are the keys with one prefix, an interval of the sorted
keys. A path prefix is an interval of the paths below one rule host. Intervals of prefixes
nest or are disjoint. ``sweep`` sorts interval edges and points together and runs through
them with a stack: an edge opens or closes a rule, and a point takes the stack as it stands.
It runs twice, over hosts and over (rule host, path). Of all rules on the stacks of a url
the one of best precedence decides: lowest ``rank``, longest rule, longest host.

The sorted events are cut into slices by range; each slice is swept alone, from the stack
that the edges of the slices before it leave open. That carry is made from the edges only, a
few rows a slice, so a host with most of the urls, or a rule over most of them, is spread
over slices. Nothing is broadcast by hint, and rules may be as many as urls.

Defined cases: a NULL url, or one without ``://``, has an empty host and path, which only
rules of an empty host fit; equal rows each get a row; NULL ids are kept; a rule with a NULL
host, path or verdict is left out; of rules with equal host and path the lower rank, then
``block``, holds; no rules leave every url to ``otherwise``; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgrade.llm.common import only
from sparkgrade.operators.keys import global_rank
from sparkgrade.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"://([^/?#]*)([^?#]*)"
# Bytes that UTF-8 never holds: between a host and a path, and behind all that a prefix begins.
BETWEEN, BEYOND = b"\xfe", b"\xff"

BASE_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# Hosts that the filter blocks besides, where none of the base rules fits.
BLOCKED_HOSTS = ["spam-farm.example.org", "casino-win.example.org", "cheap-pills.example.com", "ads-track.example.org", "adult-x.example.net", "free-bets.example.com"]


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def host_key(host: str) -> Column:
    """Reversed labels, each closed by a dot: a subdomain's key begins with its domain's."""
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")), "utf-8")


def path_key(node: str, path: str) -> Column:
    return F.concat(F.col(node), F.lit(BETWEEN), F.encode(path, "utf-8"))


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """``points`` (key BINARY, row, ...) with ``stack``: the ``value`` of each of the ``rules``
    (key BINARY, distinct; value) whose key begins theirs, outermost first."""
    opening = rules.select("key", F.lit(1).alias("edge"), "value")
    closing = rules.select(F.concat("key", F.lit(BEYOND)).alias("key"), F.lit(-1).alias("edge"), F.lit(None).cast(rules.schema["value"].dataType).alias("value"))
    events = points.withColumn("edge", F.lit(0)).unionByName(opening.unionByName(closing), allowMissingColumns=True)
    order = [F.col("key"), F.col("edge").desc(), F.col("row")]
    sorted_ = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    sorted_ = cut_lineage(sorted_, "sweep").withColumn("slice", F.shiftright("place", 33))

    # Depth of the stack before each slice: one row a slice.
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sorted_.groupBy("slice").agg(F.sum("edge").alias("change"))
    slices = cut_lineage(slices.select("slice", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("base")), "slices")
    here = Window.partitionBy("slice").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = (F.col("base") + F.sum("edge").over(here)).alias("depth")
    edges = sorted_.where("edge != 0").join(slices, "slice").select("slice", "place", "edge", "value", depth)
    opened = cut_lineage(edges.where("edge = 1"), "opened")
    deepest = opened.agg(F.max("depth")).first()[0]
    if deepest is None:
        empty = F.array().cast(f"array<{rules.schema['value'].dataType.simpleString()}>")
        return points.withColumn("stack", empty)

    # What each slice finds on the stack: at each level the last rule opened before it.
    levels = F.explode(F.sequence(F.lit(1), F.lit(deepest).cast("int"))).alias("depth")
    last = opened.groupBy("slice", "depth").agg(F.max_by("value", "place").alias("value"))
    earlier = Window.partitionBy("depth").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    held = slices.select("slice", "base", levels).join(last, ["slice", "depth"], "left")
    held = held.withColumn("value", F.last("value", ignorenulls=True).over(earlier))
    carried = held.groupBy("slice", "base").agg(F.map_from_entries(F.collect_list(F.struct("depth", "value"))).alias("carried"))

    swept = sorted_.join(carried, "slice").withColumn("depth", depth)
    slots = [
        F.coalesce(F.last(F.when((F.col("edge") == 1) & (F.col("depth") == d), F.col("value")), ignorenulls=True).over(here), F.col("carried")[d])
        for d in range(1, deepest + 1)
    ]
    stack = F.slice(F.array(*slots), F.lit(1), F.col("depth").cast("int"))
    return swept.withColumn("stack", stack).where("edge = 0").select(*points.columns, "stack")


def ranked(rules: DataFrame) -> DataFrame:
    """``rules`` (host, path, verdict, and rank if some go before others) with their keys and
    ``number``, ascending by precedence."""
    if "rank" not in rules.columns:
        rules = rules.withColumn("rank", F.lit(0))
    named = only(rules, "host", "path", "verdict", "rank").where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    named = named.withColumn("host", F.translate("host", UPPER, LOWER))
    single = named.groupBy("host", "path").agg(F.min(F.struct("rank", F.col("verdict") != "block", "verdict")).alias("at"))
    single = single.select("host", "path", "at.verdict", "at.rank")
    size = F.length("host") + F.length("path")
    numbered = global_rank(single, ["rank", -size, -F.length("host"), "host", "path"], "number")
    node = F.when(F.col("host") == "", F.lit(b"")).otherwise(host_key("host")).alias("node")
    return cut_lineage(numbered.select("*", node), "rules")


def verdicts(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", key: str = "page_id") -> DataFrame:
    """One row per row of ``pages`` (``key``, url): key, host, path, the deciding rule's text
    and rank (NULL without one), and the verdict."""
    known = ranked(rules)
    urls = only(pages, key, "url").select(F.col(key).alias("id"), host_of("url").alias("host"), path_of("url").alias("path"))
    urls = cut_lineage(urls.withColumn("row", F.monotonically_increasing_id()), "urls")

    nodes = known.select(F.col("node").alias("key"), F.col("node").alias("value")).distinct()
    below = sweep(urls.select(host_key("host").alias("key"), "row", "path"), nodes)
    below = below.select("row", "path", F.explode("stack").alias("node"))
    paths = known.select(path_key("node", "path").alias("key"), F.col("number").alias("value"))
    fitting = sweep(below.select(path_key("node", "path").alias("key"), "row"), paths)
    best = fitting.where(F.size("stack") > 0).groupBy("row").agg(F.min(F.array_min("stack")).alias("number"))

    deciding = known.select("number", F.concat("host", "path").alias("rule"), F.col("verdict").alias("said"), "rank")
    return urls.join(best, "row", "left").join(deciding, "number", "left").select(
        F.col("id").alias(key), "host", "path", "rule", F.coalesce("said", F.lit(otherwise)).alias("verdict"), "rank",
    )


def default_rules(spark: SparkSession) -> DataFrame:
    """The base rules, and behind them the blocked hosts."""
    rows = [(*r, 0) for r in BASE_RULES] + [(h, "", "block", 1) for h in BLOCKED_HOSTS]
    return spark.createDataFrame(rows, "host string, path string, verdict string, rank int")


def report(pages: DataFrame) -> DataFrame:
    """The verdicts under the default rules; ``rule`` names base rules only."""
    judged = verdicts(pages, default_rules(pages.sparkSession))
    return judged.select("page_id", "host", "path", F.when(F.col("rank") == 0, F.col("rule")).alias("rule"), "verdict")
