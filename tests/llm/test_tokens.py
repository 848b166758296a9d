"""Token counts, piece ids and records against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkgrade.llm import bpe, pieces, records, token_counts
from sparkgrade.llm.token_counts import Machine, border_counts, scan

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SENTENCES = sentencepiece.SentencePieceProcessor(model_file=PIECES)
SCRAPS = [
    "a", "the", " ", "  ", "   ", "'", "'S", "'re", "'r", "'l", "'ll", "'V", "ve", "\n", "\t", "é", "É", "中", "😀", "0", "12",
    "<|endoftext|>", "<|startoftext|>", "<|endof", "</w>", "<0x41>", "</s>", "▁", "İ", "Σ", "́", "\x00", "\x1c", "\x85", "qu",
    " ", "ing", " wor", "ld", "ﬁ", "﻿", "½", "Ⅷ", "Å", "!", "!!'s", "_", "ß", "×", "ÿ", "ª",
]


@pytest.fixture(scope="module")
def scraps():
    pick = random.Random(5)
    return ["".join(pick.choice(SCRAPS) for _ in range(pick.randint(0, 14))) for _ in range(3000)] + [" " * n for n in range(40)]


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def piece_library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_machine_counts_as_the_library_for_any_chunk(words, scraps):
    machine = Machine(WORDS)
    for text in scraps:
        want = len(ids(words, text))
        assert all(border_counts(machine, text, chunk)[-1] == want for chunk in (1, 3, 16_384)), repr(text)


def test_border_counts_are_counts_of_prefixes(words, prose):
    machine, text = Machine(WORDS), prose(1, least=500, most=500)[0]
    counts = border_counts(machine, text, 100)
    assert counts[:3] == [len(ids(words, text[:n])) for n in (100, 200, 300)]


def test_scan_is_a_prefix_scan():
    for n in range(20):
        assert scan(list("abcdefghijklmnopqrst"[:n]), lambda a, b: a + b) == ["abcdefghijklmnopqrst"[:i + 1] for i in range(n)]


def test_counts_stay_right_when_compiled_states_are_dropped(words, scraps):
    machine = Machine(WORDS, limit=50)
    machine.automaton.limit = 50
    assert [border_counts(machine, t)[-1] for t in scraps[:300]] == [len(ids(words, t)) for t in scraps[:300]]
    whole = [t.replace(" ", "") for t in scraps[:300]]
    found, ends = machine.encode(whole)
    assert [found[a:b].tolist() for a, b in zip([0, *ends], ends)] == [ids(words, t) for t in whole]


def test_token_counts(odd_rows, words):
    rows = token_counts.token_counts(odd_rows, WORDS, limit=100).collect()
    assert len(rows) == odd_rows.count()
    want = sorted(str((r.doc_id, len((r.text or "").encode()), len(ids(words, r.text)))) for r in odd_rows.collect())
    assert sorted(str((r.doc_id, r.n_bytes, r.n_tokens)) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert token_counts.token_counts(odd_rows.limit(0), WORDS).count() == 0


def test_pieces_as_the_library(piece_library, scraps):
    encoder = pieces.PieceEncoder(PIECES)
    ids = lambda texts: [np.frombuffer(e, np.int32).tolist() for e in encoder.encode(texts)]
    assert ids(scraps) == [piece_library.encode(t) for t in scraps]
    encoder.automaton.limit = 20
    assert [piece_library.encode(t) for t in scraps[:200]] == [ids([t])[0] for t in scraps[:200]]


def test_piece_rows(odd_rows, piece_library):
    want = sorted(str((r.doc_id, piece_library.encode(r.text or ""))) for r in odd_rows.collect())
    rows = pieces.encode(odd_rows, PIECES).collect()
    assert sorted(str((r.doc_id, list(r.ids))) for r in rows) == want
    digest = pieces.digests(odd_rows, PIECES).collect()
    hashes = {hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest(): hashlib.sha256(piece_library.decode(list(r.ids)).encode()).hexdigest() for r in rows}
    assert all(hashes[d.ids_sha256] == d.decoded_sha256 for d in digest) and len(digest) == len(rows)
    assert pieces.encode(odd_rows.limit(0), PIECES).count() == 0


def test_frames_hold_their_payload_and_show_damage():
    framed = records.frame(b"\x02abcdef")
    assert records.unframe(framed) == b"\x02abcdef"
    for i in range(len(framed)):
        with pytest.raises(ValueError):
            records.unframe(framed[:i] + bytes([framed[i] ^ 1]) + framed[i + 1:])
    with pytest.raises(ValueError):
        records.unframe(framed[:-1])


def test_records_round_trip(spark, odd_rows, words):
    rows = records.round_trip(odd_rows, WORDS, 2).collect()
    by_start = sorted(rows, key=lambda r: (r.start, r.n_tokens))
    assert [r.doc_id for r in by_start] == sorted([r.doc_id for r in rows], key=lambda i: (i is not None, i))
    assert [r.start for r in by_start] == [sum(x.n_tokens for x in by_start[:i]) for i in range(len(by_start))]
    want = sorted(zlib.crc32(np.array([*ids(words, r.text), 2], "<u4").tobytes()) for r in odd_rows.collect())
    assert sorted(r.ids_crc32 for r in rows) == want
    assert records.round_trip(odd_rows.limit(0), WORDS, 2).count() == 0


def test_index_reads_any_subset_in_any_order(spark, small_docs, words, tmp_path):
    folder = f"file://{tmp_path}/records"
    index = records.write_records(small_docs.repartition(5), WORDS, 2, folder)
    some = records.read_records(index.where("doc_id % 7 = 3").orderBy(index["doc_id"].desc()), folder).collect()
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    assert len(some) == sum(i % 7 == 3 for i in texts)
    assert all(list(r.ids) == [*ids(words, texts[r.doc_id]), 2] for r in some)


def test_latin_words_go_to_the_library_many_at_once(prose):
    """The ids of the library on whole texts, from few calls of it."""
    words, calls = records.WordBytes(WORDS), []

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return self.library.encode_batch_fast(texts, **options)

    library = words.library
    words.library = Counted(words.library)
    if hasattr(words, "inner"):
        words.inner = Counted(words.inner)
    texts = [" ".join(prose(300, seed=3)), "straße ÆON naïve ÿ ×÷ 'tis don't µ ª ½ " + "é" * 3000, "a-b c_d 12 <|endoftext|> 中文 😀"]
    got = [np.frombuffer(i, "<u2").tolist() for i in words.ids(pa.array(texts))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(words.words) > 800 and len(calls) < 50


def test_piece_workers_hold_little(piece_library):
    """The table widens by a few columns, in rows that are touched on use; the cache is small."""
    symbols = [chr(c) for c in [*range(97, 123), *range(224, 246), *range(945, 969)]]
    pick = random.Random(8)
    texts = [" ".join("".join(pick.choice(symbols) for _ in range(pick.randint(1, 9))) for _ in range(200)) for _ in range(20)]
    encoder = pieces.PieceEncoder(PIECES)
    assert [np.frombuffer(e, np.int32).tolist() for e in encoder.encode(texts)] == [piece_library.encode(t) for t in texts]
    assert 64 < len(encoder.automaton.symbols) <= 96 and encoder.automaton.next.shape[1] == 96
    assert pieces.CACHED_BYTES <= 16 << 20


def test_compatible_tokens_are_told_by_few_ranks():
    """As merging tells them, with at most one rank a merge that is taken back."""
    asked, pick = [], random.Random(10)
    scores = {p: -s for i in range(32_000) if len(p := SENTENCES.id_to_piece(i)) > 1 and not p.startswith("<") for s in [SENTENCES.get_score(i)]}
    few = {a + b: i for i, (a, b) in enumerate([("a", "a"), ("a", "b"), ("aa", "b"), ("ab", "a"), ("b", "a"), ("aa", "aa"), ("ba", "ba"), ("aab", "aa")])}
    odd = {"bc": 5, "abc": 2, "ab": 9, "cd": 1, "abcd": 0, "bcb": 3, "da": 4}  # "abc" is made by a worse merge
    for ranks, letters in ((scores, ""), (few, "ab"), (odd, "abcd")):
        machine = bpe.Automaton(set(ranks) | set(letters), lambda a, b: asked.append(1) or ranks.get(a + b), counts=False)  # noqa: B023
        tokens = sorted(t for t in machine.tokens if machine.merged(t) == [t])
        pairs = [(pick.choice(tokens), pick.choice(tokens)) for _ in range(3000)] if ranks is scores else [(a, b) for a in tokens for b in tokens]
        want = [machine.merged(a + b) == [a, b] for a, b in pairs]
        assert [machine.compatible(a, b) for a, b in pairs] == want and 0 < sum(want) < len(want)
        if ranks is scores:
            asked.clear()
            assert [machine.compatible(a, b) for a, b in pairs] == want
            assert len(asked) < sum(len(a + b) for a, b in pairs)
