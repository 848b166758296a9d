"""Secrets, templates, quality, line rules, language and the pipeline."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkgrade.llm import language, line_frequency, pieces, quality, secret_scan, templates
from sparkgrade.llm.trigrams import trigram_query

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def slow_spans(text):
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    more = [(m.start(), i, m.end()) for i, r in enumerate(secret_scan.RULES) if i > 2 for m in re.finditer(r.pattern, text, re.A)]
    write = lambda spans: ",".join(f"{secret_scan.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(spans))
    return write(base), write(base + more), [sum(s[1] == k for s in base) for k in range(3)]


@pytest.fixture(scope="module")
def secret_texts():
    pick = random.Random(2)
    scraps = [
        "token", " = ", "secret", "PassWord", ":", "=", '"', "'", "apikey", "api_key", "  ", "abcdefgh12", "x", "AKIA",
        "ABCDEFGH12345678", "deadbeef" * 4, "0123456789abcdef" * 2, "é", "😀", "\n", "-----BEGIN RSA PRIVATE KEY-----",
        "ghp_" + "a1" * 20, "eyJabcdefghijkl.eyJabcdefghijkl.abcdefghijk", "http://u:p@h", "K", "ſecret", " ", "a", "/", "+",
    ]
    return ["".join(pick.choice(scraps) for _ in range(pick.randint(0, 14))) for _ in range(1500)]


def test_secrets(spark, odd_rows, secret_texts):
    docs = spark.createDataFrame(list(enumerate(secret_texts)), "doc_id long, text string")
    docs = docs.union(odd_rows.select(F.lit(-1).cast("long"), "text"))
    want = []
    for r in docs.collect():
        base, spans, counts = slow_spans(r.text or "")
        want.append((r.doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), spans))
    assert sorted(tuple(r) for r in secret_scan.report(docs).collect()) == sorted(want)
    assert secret_scan.report(odd_rows).count() == odd_rows.count() and secret_scan.report(docs.limit(0)).count() == 0


def test_redaction_leaves_the_rest(spark, odd_rows, secret_texts):
    docs = spark.createDataFrame([(i, t, len(t), "s") for i, t in enumerate(secret_texts)], "doc_id long, text string, n_chars long, spans string")
    for r in secret_scan.redact(docs).collect():
        text, at, out = secret_texts[r.doc_id], 0, ""
        _, spans, _ = slow_spans(text)
        for a, b in [map(int, s.split(":")[1:]) for s in spans.split(",") if s]:
            out += "" if a < at else text[at:a] + "[SECRET]"
            at = max(at, b)
        assert (r.text, r.n_chars) == (out + text[at:], len(r.text))
    plain = secret_scan.redact(odd_rows)
    assert plain.columns == odd_rows.columns and sorted(map(str, plain.collect())) == sorted(map(str, odd_rows.collect()))


def test_trigram_queries_hold_for_every_match(secret_texts):
    assert trigram_query("[0-9a-f]{32,}") is None and trigram_query("(abc|de)x") == frozenset({frozenset({"abc", "bcx"}), frozenset({"dex"})})
    for rule in secret_scan.RULES:
        query = trigram_query(rule.pattern)
        for text in secret_texts:
            if query is not None and re.search(rule.pattern, text, re.A):
                assert any(all(t in text.lower() for t in needed) for needed in query), (rule.kind, text)


ITEM = "Anna has 5 apples and buys 12,5 kg of flour for Bert. Then she walks 3 km/h, to Paris!"
OTHER = "Anna has 5 apples and buys 12,5 kg of flour for Bert while Anna gives 5 pears to Bert today at home"


def test_templates(spark, odd_rows):
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, "a b"), (5, "")], "item_id long, text string")
    texts = {
        1: "Then: Anna has 7 apples and buys 99 kg of flour for Carl. Then she walks 44 km/h, to Rome and more",
        2: "before it " + ITEM + " after it", 3: OTHER.replace("5 pears to Bert", "8 pears to Dora"),
        4: OTHER.replace("12,5 kg", "1 kg").replace("5", "6").replace("Bert", "Carl"), 5: "Anna has 5 apples and then goes home to sleep early",
    }
    docs = spark.createDataFrame([*texts.items(), (None, ITEM), (2, texts[2])], "doc_id long, text string")
    docs = docs.union(odd_rows.select("doc_id", "text").where("text IS NULL OR doc_id > 5"))
    got = {(r.doc_id, r.item_id): r.reworked for r in templates.report(docs, items).collect()}
    assert got == {(1, 1): True, (2, 1): False, (4, 2): True, (None, 1): False}
    left = templates.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect() if r.text} == {3, 5, 6, 7, 8}
    assert templates.report(docs, items.limit(0)).count() == 0 and templates.report(docs.limit(0), items).count() == 0
    assert templates.decontaminate(odd_rows, items).columns == odd_rows.columns


def test_items_with_renamed_openers_and_short_items(spark):
    tom = "Tom has 3 apples. Tom buys 4 more apples. How many apples does Tom have now?"
    short = ["What is the capital of France?", "Who wrote the first novel?", "When did the long war of the north end?"]
    items = spark.createDataFrame([(0, tom), *enumerate(short, 1)], "item_id long, text string")
    anna = tom.replace("Tom", "Anna").replace("3", "8").replace("4", "9")
    docs = [
        (0, anna), (1, "please answer " + short[0]), (2, "Then: " + short[1]), (3, "please answer " + short[2] + " Thanks"),
        (4, anna.replace("Anna buys", "Carl buys").replace("does Anna", "does Dora")), (5, "so, " + anna[0].lower() + anna[1:]), (6, '"' + anna + '"'),
    ]
    found = {(r.doc_id, r.item_id) for r in templates.report(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert {(0, 0), (1, 1), (2, 2), (3, 3), (6, 0)} <= found and not any(i == 4 for i, _ in found)


def test_benchmark_passages_are_found(spark):
    """Brute force: documents that hold all words of an item in a row."""
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    joined = lambda t: " " + " ".join(t.split()) + " "
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if joined(i.text) in joined(d.text)}
    got = {(r.doc_id, r.item_id) for r in templates.report(docs, items).collect()}
    assert want and want <= got and len(got) <= len(want) + 2


def test_quality_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_factor_machine_scores_as_the_double_sum():
    import numpy as np

    random_ = np.random.default_rng(1)
    machine = quality.FactorMachine(0.3, random_.normal(size=quality.FEATURES), random_.normal(size=(quality.FEATURES, 3)))
    at, value = np.array([5, 9, 70, 4000]), np.array([0.5, 1.0, 2.0, 0.1])
    want = 0.3 + machine.weights[at] @ value
    want += sum(machine.factors[at[i]] @ machine.factors[at[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    assert abs(machine.raw(at, value) - want) < 1e-9


def test_quality_of_odd_rows(spark, odd_rows):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (5, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd_rows, labels).collect()
    assert len(rows) == odd_rows.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(odd_rows, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(odd_rows.limit(0), labels).count() == 0
    assert quality.accepted(odd_rows, labels).columns == odd_rows.columns


def test_line_rules_on_odd_rows(odd_rows):
    rows = line_frequency.quality_rules(odd_rows).collect()
    assert len(rows) == odd_rows.count()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert {(r.n_words, r.word_chars, r.n_repeat_words) for r in rows if r.doc_id == 6} == {(20_000, 80_000, 20_000)}
    assert line_frequency.quality_rules(odd_rows.limit(0)).count() == 0


def test_lines_frequent_on_a_host_are_removed(spark, prose):
    own = prose(60, least=60, most=90)
    rows = []
    for i, text in enumerate(own):
        host = None if i < 20 else "a" if i < 40 else "b"
        words = text.split()
        rows.append((i, "\n".join([f"Cookie  NOTICE {i}", *([" ".join(words[:10])] if i % 2 else [text])] + (["menu " * 60] if host == "a" else [])), host))
    rows += [(100 + i, "same text " + own[0], "b") for i in range(15)]  # copies are one document
    found = {r.doc_id: r for r in line_frequency.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, text, host in rows[:60]:
        assert found[i].n_words - found[i].left_words == 3 + (60 if host == "a" else 0)
    assert all(r.left_words == r.n_words for i, r in found.items() if i >= 100)
    assert not found[21].kept and found[50].kept and found[22].base_failed == (found[22].n_repeat_words * 2 > found[22].n_words)


def test_language_of_held_out_rows(spark, odd_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    odd = language.identify(odd_rows).collect()
    assert len(odd) == odd_rows.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in odd if r.doc_id in (2, 3, 4, 8)} == {"und"}
    assert {r.lang_pred for r in language.identify(odd_rows.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(odd_rows.limit(0)).count() == 0


def test_known_words_come_first_then_shorter_grams(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en")] * 5)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.names == ["de", "en"] and model.predict("Der Hund")[0] == "de" and model.predict("the cats")[0] == "en"
    assert (model.backoff("thexx") == (model.grams["<the"] if "thex" not in model.grams else 0)).all()
    assert (model.backoff("ж") == 0).all()


def test_unseen_words_count_to_their_end(spark):
    model = language.LanguageModel(["a", "b"], {}, {"x": language.np.array([-1.0, -2.0]), "y": language.np.array([-2.0, -1.0])})
    assert model.predict("x" * 64 + "y" * 200)[0] == "b" and model.predict("x" * 64 + "y" * 20)[0] == "a"
    docs = spark.createDataFrame([(1, "x" * 70 + "qrst", "a"), (2, "y" * 70, "b")], "doc_id long, text string, lang string")
    assert {"qrst", "rst>", "<xxx", "<", ">"} - {"<", ">"} <= set(language.train(docs).grams)


def five_word_classes(texts):
    """Brute force: classes of ids whose texts have five-word similarity 0.8 or more."""
    sets = {}
    for i, text in texts.items():
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets[i] = {tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def test_pipeline_against_its_parts(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    labels, items = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    single = set(five_word_classes(texts).values())
    clean = single - {r.doc_id for r in templates.report(docs, items).collect()}
    assert sorted(r.doc_id for r in rows) == sorted(clean)
    encoder = pieces.PieceEncoder(corpus_pipeline.public_tokenizers.path(corpus_pipeline.PIECES))
    masked = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert all(r.ids == encoder.library.encode(masked[r.doc_id]) and r.intact for r in rows)


def test_pipeline_stages_keep_columns_and_take_odd_rows(spark, odd_rows):
    folder, docs = "/root/testdata/sf0.001", odd_rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == odd_rows.columns, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, folder).count() == docs.count()
    assert last(spark, odd_rows.limit(0), folder).count() == 0
