"""Url rules, the Merkle manifest and the filter audit against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations

from pyspark.sql import functions as F

from sparkgrade.llm import filter_audit, merkle, url_rules

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = host.translate(ASCII_LOWER)
    fits = lambda h: h == "" or host == h or host.endswith("." + h)
    found = [(k, -len(h) - len(p), -len(h), h, p, v != "block", v) for h, p, v, k in rules if None not in (h, p, v) and fits(h) and path.startswith(p)]
    if not found:
        return host, path, None, "allow"
    # Equal host and path: the lower rank, then block, stands.
    best = min(found)
    return host, path, best[3] + best[4], best[6]


def check_urls(spark, urls, rules):
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("verdict", F.lit(1)).withColumn("row", F.lit("x")).repartition(5)
    table = spark.createDataFrame(rules, "host string, path string, verdict string, rank int")
    got = sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in url_rules.verdicts(pages, table).collect())
    assert got == sorted(str((i, *slow_verdict(u, rules))) for i, u in urls)


def test_url_rules_against_every_rule(spark):
    pick = random.Random(3)
    labels, paths = ["a", "b", "ab", "", "c", "net", "é"], ["", "/", "/a", "/a/", "/a/b", "/ab", "/b", "/a/b/c"]
    hosts = [".".join(pick.choice(labels) for _ in range(pick.randint(1, 5))) for _ in range(200)]
    rules = [(pick.choice(hosts) if pick.random() < 0.9 else "", pick.choice(paths), pick.choice(["allow", "block"]), pick.randint(0, 1)) for _ in range(150)]
    urls = [(i, "https://" + pick.choice(hosts).upper() + pick.choice(paths) + pick.choice(["", "?q=/a", "#x", "/c/d"])) for i in range(800)]
    urls += [(None, None), (3, "nohost"), (3, "nohost"), (4, "http://"), (5, "x://a.b/a/b://c"), (6, ""), (7, "http://" + "a." * 300 + "net/" + "x" * 5000)]
    check_urls(spark, urls, [*rules, (None, "/", "block", 0), ("a", None, "block", 0), ("a", "/", None, 0)])


def test_url_rules_with_one_host_for_most(spark):
    rules = [("hot.net", f"/{i}/", "block", 0) for i in range(60)] + [("hot.net", "/7/7/", "allow", 0), ("net", "", "allow", 0)]
    check_urls(spark, [(i, f"http://www.hot.net/{i % 70}/{i % 9}/") for i in range(900)] + [(i, f"http://h{i}.org/") for i in range(100)], rules)


def test_url_rules_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = url_rules.default_rules(spark).limit(0)
    assert [tuple(r) for r in url_rules.verdicts(pages, none, "block").collect()] == [(1, "a.net", "/", None, "block", None)]
    assert url_rules.report(pages.limit(0)).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_tree(nodes):
    """Root, and per first node the siblings before and behind it, level by level."""
    trails, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place // 16 * 16:place // 16 * 16 + 16]
            trails[i].append(("".join(run[:place % 16]), "".join(run[place % 16 + 1:])))
        level = [sha("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
        at = [place // 16 for place in at]
    return level[0], trails


def slow_manifest(rows):
    def leaf(row, text):
        fields = [None if f is None else str(f) for f in (row.doc_id, row.source, row.lang, row.n_chars, text)]
        return sha("".join("-" if f is None else f"{len(f.encode())}:{f}" for f in fields))

    trees = {}
    for row in rows:
        trees.setdefault(row.source, []).append((row.doc_id is not None, row.doc_id or 0, leaf(row, row.text), row))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subtrees = [slow_tree([n[2] for n in sorted(trees[s], key=lambda n: n[:3])]) for s in sources]
    root, above = slow_tree([sub for sub, _ in subtrees])
    out = []
    for source, (sub, trails), rest in zip(sources, subtrees, above):
        for (_, _, own, row), trail in zip(sorted(trees[source], key=lambda n: n[:3]), trails):
            tampered = row.doc_id is not None and row.text is not None and zlib.crc32(str(row.doc_id).encode()) % 5 == 0
            node = leaf(row, row.text.translate(ASCII_LOWER)) if tampered else own
            for before, behind in trail + rest:
                node = sha(before + node + behind)
            out.append(str((row.doc_id, own, sub, root, sha("".join(a + b for a, b in trail + rest)), node, node == root)))
    return sorted(out)


def written(rows):
    return sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)) for r in rows)


def test_manifest_over_superblocks(spark):
    """One source with more than two superblocks, one with exactly one and a leaf, many small ones."""
    source = F.when(F.col("id") < 8_250, "hot").when(F.col("id") < 8_250 + 4_097, "b").otherwise(F.concat(F.lit("s"), F.col("id") % 400))
    docs = spark.range(13_000).select(
        F.col("id").alias("doc_id"), source.alias("source"), F.lit("en").alias("lang"), F.lit(3).cast("long").alias("n_chars"),
        F.concat(F.lit("Text é"), F.col("id")).alias("text"),
    ).repartition(6)
    got = merkle.audit(docs).collect()
    assert written(got) == slow_manifest(docs.collect())
    assert 0.15 < sum(not r.verified for r in got) / len(got) < 0.25


def test_manifest_of_odd_rows(spark, odd_rows):
    assert written(merkle.audit(odd_rows).collect()) == slow_manifest(odd_rows.collect())
    assert all(r.verified for r in merkle.manifest(odd_rows).collect())
    assert merkle.audit(odd_rows.limit(0)).count() == 0
    single = merkle.manifest(odd_rows.limit(1)).first()
    assert single.leaf == single.subroot == single.root and single.proof_sha256 == sha("")


def slow_audit(docs, labels):
    good = {r.doc_id for r in labels if r.doc_id is not None and r.quality == 1}
    toxic = {r.doc_id for r in labels if r.doc_id is not None and r.toxic == 1}
    smallest = {}
    for r in docs:
        if r.doc_id is not None:
            smallest[r.text or ""] = min(smallest.get(r.text or "", r.doc_id), r.doc_id)
    rows = []
    for r in docs:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "".join(f for f, c in zip("ABCDE", [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            re.search("[#$%&*|]", text) is not None, r.doc_id is not None and r.doc_id > smallest[text]]) if c)
        rows.append((r.lang or "", fails, r.doc_id))
    out = {}
    for part in {r[0] for r in rows}:
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, own in enumerate(order, 1):
                gone = [r for r in left if own in r[1]]
                left = [r for r in left if own not in r[1]]
                failing = [r for r in rows if r[0] == part and own in r[1]]
                removed_by[own] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(r[1] == own for r in failing),
                    sum(r[2] in good for r in gone), sum(r[2] in toxic for r in gone), own]
        for (p, _, _), counts in out.items():
            if p == part:
                counts[-1] = removed_by[counts[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in filter_audit.audit(docs, labels).collect()}


def test_filter_audit_against_every_order(spark, odd_rows, prose):
    pick = random.Random(4)
    texts = prose(60, least=60, most=160)
    texts += [t.upper() for t in texts[:8]] + [t + " 100 %" for t in texts[5:20]] + ["one two " * 70, "", None]
    rows = [(i, pick.choice(texts), pick.choice(["en", "de", "", None])) for i in range(400)]
    rows += [(5, rows[5][1], "en"), (None, texts[0], "en"), (None, texts[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6).unionByName(odd_rows.select("doc_id", "text", "lang"))
    marks = [(pick.randrange(400), pick.choice([0, 1, None]), pick.choice([0, 1])) for _ in range(200)] + [(None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(0)).withColumn("part", F.lit("x"))
    assert audited(docs, labels) == slow_audit(docs.collect(), labels.collect())


def test_filter_audit_of_odd_and_empty_tables(spark, odd_rows):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    clashing = odd_rows.withColumn("mask", F.lit(1)).withColumn("part", F.lit("p")).withColumn("hash", F.lit(2)).withColumn("block", F.lit(3))
    assert audited(clashing, labels) == slow_audit(odd_rows.collect(), labels.collect())
    assert filter_audit.audit(odd_rows.limit(0), labels).count() == 0
    assert audited(odd_rows, labels.limit(0)) == slow_audit(odd_rows.collect(), [])


def test_sketch_without_broadcast_and_its_bits(spark, monkeypatch):
    """Every repeated text may repeat, few unique ones do; the same when the sketch is joined by block."""
    monkeypatch.setattr(filter_audit, "MOST_BLOCKS", 0)
    texts = spark.range(20_000).select(F.xxhash64(F.col("id") % 15_000).alias("hash"))
    hashed = texts.select("hash", F.xxhash64(F.lit(1), "hash").alias("mixed"), F.pmod("hash", F.lit(79)).cast("int").alias("block"))
    often = filter_audit.sketch(hashed.repartition(7)).cache()
    assert often.count() == 79 and all(len(r.often) == 64 for r in often.collect())
    rows = filter_audit.probed(hashed, often, 79).groupBy("hash").agg(F.count("*").alias("n"), F.max("maybe").alias("maybe")).collect()
    assert all(r.maybe for r in rows if r.n > 1) and sum(r.maybe for r in rows if r.n == 1) < 200
