"""SimHash classes and repeated passages against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from sparkgrade.llm import near_copies, passages, simhash
from sparkgrade.llm.common import row_key
from sparkgrade.llm.components import components


def slow_fingerprint(text: str) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components(spark):
    pick = random.Random(2)
    links = [(pick.randrange(400), pick.randrange(400)) for _ in range(250)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 600 + i) for i in range(90)]
    want = slow_classes(links, {n for p in links for n in p})
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert set(got) == linked
    classes = {}
    for n in linked:
        classes.setdefault(want[n], set()).add(got[n])
    assert all(len(c) == 1 for c in classes.values()) and len({min(c) for c in classes.values()}) == len(classes)


@pytest.mark.parametrize("threshold", [0, 1, 3, 5])
def test_near_links_are_all_links(spark, threshold):
    pick = random.Random(threshold)
    values = {pick.getrandbits(64) & ~0xFF00 for _ in range(300)}
    for v in list(values):
        for _ in range(3):
            for _ in range(pick.randint(1, 5)):
                v ^= 1 << pick.randrange(64)
            values.add(v)
    values = np.array(sorted(values), np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= threshold
    signed = values.view(np.int64)
    want = {tuple(sorted((int(signed[i]), int(signed[j])))) for i, j in zip(*np.nonzero(near)) if i < j}
    nodes = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    assert {(r.a, r.b) for r in simhash.near_links(nodes, threshold).collect()} == want


def test_thresholds_sum_up():
    both = np.full((64, 64), 25) + 25 * np.eye(64, dtype=int)
    for threshold in range(6):
        plan = simhash.probing_plan(100, both, threshold)
        parts = {len(simhash.correlated_groups(100, both, p)) for p in range(1, threshold + 2)}
        assert any(sum(r for _, r in plan) - (p - len(plan)) == threshold - p + 1 for p in parts)


def test_near_duplicates(odd_rows, small_docs):
    docs = small_docs.select("doc_id", "text").union(odd_rows.select("doc_id", "text"))
    texts = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    prints = {f for _, f in texts}
    want = slow_classes([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3], prints)
    least = {}
    for i, f in texts:
        if i is not None:
            least[want[f]] = min(i, least.get(want[f], i))
    got = simhash.near_duplicates(docs).collect()
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=key) == sorted(
        [(i, f"{f:016x}", least.get(want[f])) for i, f in texts], key=key)
    kept = simhash.one_of_each(odd_rows)
    assert kept.columns == odd_rows.columns
    assert kept.count() == len({want[slow_fingerprint(r.text)] for r in odd_rows.select("text").collect()})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(odd_rows.limit(0)).count() == 0


def altered(words, share, pick):
    out = []
    for w in words:
        r = pick.random()
        if r >= share / 3:
            out.append(f"new{pick.randrange(10**6)}" if r < 2 * share / 3 else w)
        if r > 1 - share / 3:
            out.append(f"more{pick.randrange(10**6)}")
    return out


@pytest.mark.parametrize("share", [0.0, 0.06])
def test_planted_passages_are_found_and_nothing_else(spark, share):
    pick = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: [pick.choice(vocabulary) for _ in range(n)]
    planted, rows, holders = [text(75) for _ in range(6)], [], {}
    for i in range(150):
        words = text(pick.randint(20, 300))
        if i % 3 == 0:
            k, at = pick.randrange(6), pick.randint(0, len(words))
            holders.setdefault(k, set()).add(i)
            words[at:at] = altered(planted[k], share, pick)
        rows.append((i, pick.choice([" ", "\n"]).join(words)))
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for holding in holders.values():
        others = {r.doc_id for r in found if r.doc_id in holding and r.source_doc_id in holding}
        assert len(holding) < 2 or len(holding - others) <= (1 if share == 0 else 2)
    assert all(any({r.doc_id, r.source_doc_id} <= h for h in holders.values()) for r in found)
    if share == 0:
        words = {i: t.split() for i, t in rows}
        assert all(words[r.doc_id][r.start_word:r.end_word] == words[r.source_doc_id][r.source_start:r.source_end] for r in found)


def test_chains_are_best_chains():
    pick = random.Random(4)
    for _ in range(200):
        points = sorted({(pick.randrange(60), pick.randrange(60)) for _ in range(pick.randint(1, 12))})
        x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
        best = {}
        for i, (a, b) in enumerate(points):
            gains = [best[j] - passages.GAP_COST * (a - points[j][0] + b - points[j][1]) for j in range(i) if points[j][0] < a and points[j][1] < b]
            best[i] = passages.SEED_WEIGHT + max([0.0, *gains])
        chains = passages.chains_of(x, y)
        assert sorted(i for c in chains for i in c) == list(range(len(points)))
        assert all(x[a] < x[b] and y[a] < y[b] for c in chains for a, b in zip(c, c[1:]))
        top = chains[0]
        score = passages.SEED_WEIGHT * len(top) - passages.GAP_COST * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(top, top[1:]))
        assert abs(score - max(best.values())) < 1e-6


def test_two_passages_of_one_holder_stay_apart(spark):
    one, two = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    between = lambda name: [f"{name}{i}" for i in range(300)]
    rows = [(i, " ".join(one + between(f"x{i}-") + two)) for i in (1, 2)]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.start_word, r.end_word) for r in found) == [(0, 200), (500, 700)]


def test_odd_rows_have_no_passages_but_shared_ones(spark, odd_rows):
    found = passages.passages(odd_rows).collect()
    assert found == [] and passages.passages(odd_rows.limit(0)).count() == 0
    long = " ".join(f"v{i}" for i in range(90))
    same = spark.createDataFrame([(1, long), (1, long), (None, "start " + long), (2, None)], "doc_id long, text string")
    rows = passages.passages(same).select("doc_id", "source_doc_id").distinct().collect()
    assert {frozenset((r.doc_id, r.source_doc_id)) for r in rows} == {frozenset((1, None))}


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_stage_keeps_one_of_every_five_word_class(spark, prose):
    """Brute force: components of the pairs with five-word similarity 0.8 or more."""
    pick, rows = random.Random(9), []
    line = "all rights reserved by the owners of this very page and of all that it holds "
    for i, base in enumerate(prose(40, seed=5, least=60, most=180)):
        for _ in range(30 if i == 0 else 4):
            words = base.split()
            for _ in range(pick.randrange(5)):
                words[pick.randrange(len(words))] = f"new{pick.randrange(10**6)}"
            rows.append((len(rows), (line if i % 3 else "") + " ".join(words).upper() if pick.random() < 0.3 else " ".join(words)))
    rows += [(None, rows[0][1]), (9000, None), (9001, " "), (9002, "a b"), (9003, "A  b"), (9004, "a c"), (rows[5][0], "another text under this id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [five_words(t) for _, t in rows]
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if not a | b or 5 * len(a & b) >= 4 * len(a | b)]
    want = slow_classes(pairs, range(len(rows)))
    assert 40 < len(set(want.values())) < len(rows) - 40
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()}
    classes = {}
    for i, root in want.items():
        classes.setdefault(root, []).append(rows[i])
    assert len(kept) == len(classes)
    assert all(min((i for i, _ in c if i is not None), default=None) in {i for i, t in c if (i, t) in kept} for c in classes.values())


def spans(spark, rows):
    return passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def words_of(pick, n, size=4000):
    return [f"w{pick.randrange(size)}" for _ in range(n)]


def test_passages_whose_blocks_stand_alone_in_other_documents(spark):
    """Documents of any key hold a block of a passage; two hold the whole of it."""
    pick, rows, whole = random.Random(21), [], []
    for _, sizes in [(i, s) for i in range(12) for s in ((30, 30), (20, 20, 20))]:
        blocks = [words_of(pick, n) for n in sizes]
        for block in blocks:
            for _ in range(20):
                rows.append((len(rows), " ".join(words_of(pick, 15) + block + words_of(pick, 15))))
        whole.append((len(rows), len(rows) + 1))
        for _ in range(2):
            rows.append((len(rows), " ".join(words_of(pick, 30) + sum(blocks, []) + words_of(pick, 30))))
    found = {frozenset((r.doc_id, r.source_doc_id)) for r in spans(spark, rows)}
    assert found == {frozenset(p) for p in whole}


def test_fifty_words_at_least_agreement_are_found(spark):
    pick, rows, pairs = random.Random(22), [], []
    for least, wrong in [(50, 10), (50, 9), (50, 8), (60, 11), (80, 15)] * 12 + [(n, -6) for n in (60, 200, 1000)]:
        passage = words_of(pick, least)
        other, at = list(passage), range(5, least, 6) if wrong < 0 else pick.sample(range(least), wrong)
        for i in at:
            other[i] = f"new{pick.randrange(10**6)}"
        assert 5 * sum(a == b for a, b in zip(passage, other)) >= 4 * least
        pairs.append(frozenset((len(rows), len(rows) + 1)))
        rows += [(len(rows) + i, " ".join(words_of(pick, 40) + p + words_of(pick, 40))) for i, p in enumerate((passage, other))]
    found = {frozenset((r.doc_id, r.source_doc_id)) for r in spans(spark, rows)}
    assert found == set(pairs)


@pytest.mark.parametrize("heads", [False, True])
def test_every_copy_inside_a_document_is_found(spark, heads):
    """One document holds a passage twice; lone pieces of it come before."""
    pick = random.Random(23)
    passage = words_of(pick, 70)
    lone = passage[20:32] + words_of(pick, 60) if heads else []
    twice = lone + passage + words_of(pick, 100) + passage + words_of(pick, 20)
    rows = [(1, " ".join(twice)), *[(i, " ".join(words_of(pick, 30) + (lone if i % 2 else []) + passage + words_of(pick, 30))) for i in range(2, 8)]]
    found = [(r.doc_id, r.start_word, r.end_word) for r in spans(spark, rows)] + [(r.source_doc_id, r.source_start, r.source_end) for r in spans(spark, rows)]
    starts = [len(lone), len(lone) + 170]
    held = {s for i, a, b in found if i == 1 for s in starts if a <= s and b >= s + 70}
    holder = min((r.source_doc_id for r in spans(spark, rows)), default=None)
    assert held == set(starts) or holder == 1 and held


def test_passages_hidden_by_overlapping_pieces_in_other_documents(spark):
    """Documents of lower key hold overlapping pieces, all too short; two or six others hold the whole."""
    pick, rows, whole = random.Random(24), [], []
    for times in (2, 2, 6):
        passage = words_of(pick, 90)
        for at in [*range(53)] * 2:
            rows.append((len(rows), " ".join(words_of(pick, 15) + passage[at:at + 38] + words_of(pick, 15))))
        holders = [(10_000 + 300 * len(whole) + i, " ".join(words_of(pick, 30) + passage + words_of(pick, 30))) for i in range(300)]
        keyed = spark.createDataFrame(holders, "doc_id long, text string").withColumn("key", row_key("doc_id", "text"))
        late = [r.doc_id for r in keyed.orderBy("key").collect()[-times:]]
        whole.append(set(late))
        rows += [h for h in holders if h[0] in whole[-1]]
    found = {(r.doc_id, r.source_doc_id) for r in spans(spark, rows)}
    classes = slow_classes(found, [i for i, _ in rows])
    assert all(len({classes[i] for i in w}) == 1 for w in whole)
    assert {i for pair in found for i in pair} == set().union(*whole)


def test_near_duplicates_stage_links_by_simhash_first(spark, prose, monkeypatch):
    """The stage's fingerprints of five-word shingles, and their links within three bits, verified."""
    pick, rows = random.Random(12), []
    for base in prose(12, seed=6, least=150, most=200):
        for wrong in (0, 1, 2):
            words = base.split()
            for i in pick.sample(range(len(words)), wrong):
                words[i] = f"new{i}"
            rows.append((len(rows), " ".join(words)))
    rows += [(100, None), (101, "a b"), (102, "A  b")]
    calls, links = [], near_copies.near_links
    monkeypatch.setattr(near_copies, "near_links", lambda nodes, bits: calls.append(bits) or links(nodes, bits))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()) == [*range(0, 36, 3), 100, 101]
    assert calls == [3]
    texts = docs.withColumn("key", row_key("doc_id", "text"))
    prints = near_copies.prefixes(texts)
    node = {r.doc_id: r.node for r in prints.collect()}
    marks = {r.doc_id: simhash.fingerprint(r.text or "", 5) for r in docs.collect()}
    near = {frozenset((node[i], node[j])) for i in marks for j in marks if node[i] != node[j] and (marks[i] ^ marks[j]).bit_count() <= 3}
    found = {frozenset(r) for r in near_copies.marked_pairs(texts, prints).select("a", "b").collect()}
    assert near and found <= near and slow_classes(map(tuple, found), node.values()) == slow_classes(map(tuple, near), node.values())


def test_shared_shingles_and_bitmaps_of_the_near_duplicates_stage(spark, prose, monkeypatch):
    """Shared prefix shingles against a plain count; sets are made only of texts whose bitmaps leave a chance."""
    line = " ".join(prose(1, seed=31, least=24, most=24))
    rows = [(i, f"{line} {text}" if i % 2 else text) for i, text in enumerate(prose(60, seed=30, least=90, most=100))]
    rows += [(100, rows[3][1] + " more"), (101, None), (102, "a b"), (103, rows[5][1])]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", row_key("doc_id", "text"))
    each = near_copies.one_per_node(near_copies.prefixes(texts))
    nodes = {r.node: r for r in each.collect()}
    count = Counter(c for r in nodes.values() for c in r.prefix)
    want = set()
    for r in nodes.values():
        for pos, c in enumerate(r.prefix):
            before = sum(count[x] > 1 for x in r.prefix[:pos])
            if count[c] > 1 and 9 * (before + r.n - pos) >= 4 * (r.n + -(-4 * r.n // 5)):
                want.add((c, r.node, r.n, before, r.n - pos))
    got = near_copies.sharing(each).collect()
    assert want and set(map(tuple, got)) == want and len(got) == len(want)
    made, sets = [], near_copies.shingle_sets
    monkeypatch.setattr(near_copies, "shingle_sets", lambda docs, prints, asked: made.extend(r.node for r in asked.collect()) or sets(docs, prints, asked))
    kept = {r.doc_id for r in near_copies.one_of_each(texts.select("doc_id", "text")).collect()}
    assert kept == {*range(60), 101, 102} and len(made) == len(set(made)) == 2


def test_bitmaps_bound_what_sets_have_in_common():
    pick = np.random.default_rng(4)
    for n, m, same in ((0, 0, 0), (1, 1, 1), (1, 0, 0), (900, 1100, 880), (1000, 1030, 0), (1000, 1000, 300), (3, 4000, 3), (500, 520, 480)):
        codes = pick.integers(0, 1 << 64, n + m - same, np.uint64)
        one, two = codes[:n], codes[n - same:]
        most = near_copies.most_common(near_copies.bitmap(one), near_copies.bitmap(two), n, m)
        assert same <= most <= min(n, m) and (same > 300 or n < 1000 or 9 * most < 4 * (n + m))
