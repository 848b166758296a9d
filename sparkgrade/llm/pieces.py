"""SentencePiece encoding and decoding through a table of last tokens per prefix.

The model's pieces hold a blank mark only in front, so a text falls into segments (blank
marks and what follows them) that merges never cross. Each segment runs through the
automaton of ``bpe``: automaton matches and pair-compatibility tests give every prefix its
unique last token, and the ids are recovered backwards. Symbols without a piece become
their UTF-8 byte pieces. Decoding is the library's ``decode(ids)``.

Defined cases: a NULL or empty text has no ids and decodes to the empty text; texts of any
length are encoded whole, about a megabyte of text at a time; every input row gives one row; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkgrade.llm.bpe import Automaton
from sparkgrade.llm.common import by_size, only, per_process

BLANK = "▁"
SEGMENT = re.compile(f"{BLANK}+[^{BLANK}]*")
# Bounds of what a worker remembers: bytes of the cache, with what an entry costs beside its
# content, and characters of a remembered segment.
CACHED_BYTES, ENTRY_BYTES, CACHED_LENGTH = 16 << 20, 160, 64
# States that a worker compiles before it starts anew: a table of 50 to 70 MB.
COMPILED_STATES = 130_000


class PieceEncoder:
    """Encoder of one model file (BPE pieces with byte fallback, identity normalisation)."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            data = file.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(data)
        trainer, normalizer = model.trainer_spec, model.normalizer_spec
        inner = any(BLANK in p.piece.lstrip(BLANK) for p in model.pieces)
        if trainer.model_type != trainer.BPE or normalizer.precompiled_charsmap or inner or not normalizer.escape_whitespaces:
            raise ValueError("a BPE model with identity normalisation and leading blank marks is needed")
        if normalizer.remove_extra_whitespaces or not normalizer.add_dummy_prefix or not trainer.byte_fallback:
            raise ValueError("a model with a dummy prefix, kept blanks and byte fallback is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == p.NORMAL}
        scores = {p.piece: -p.score for p in model.pieces if p.type == p.NORMAL}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = Automaton(set(self.ids), lambda a, b: scores.get(a + b), counts=False, limit=COMPILED_STATES)
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self.written: list[bytes] = []
        self.lone = np.zeros(0, np.int32)  # the id of each of ``written``, -1 if there are several
        self.decimal = [str(i) for i in range(self.library.get_piece_size())]

    def ids_of(self, token: str) -> bytes:
        """A token's id, or the ids of its byte pieces, as 32-bit integers."""
        known = self.ids.get(token)
        return np.array([known] if known is not None else [self.bytes[b] for b in token.encode()], np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """All ids of each text as 32-bit integers. Segments of up to ``CACHED_LENGTH`` characters
        are remembered while the cache has room; it starts anew between calls when it is full."""
        cut = [SEGMENT.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if self.held > CACHED_BYTES:
            self.cache, self.held = {}, 0
        new = list({s for segments in cut for s in segments} - self.cache.keys())
        encoded = self.automaton.encode_many(new)
        more = [self.ids_of(n) for n in islice(self.automaton.names, len(self.written), None)]
        self.written += more
        self.lone = np.append(self.lone, np.array([np.frombuffer(w, np.int32)[0] if len(w) == 4 else -1 for w in more], np.int32))
        ends = np.cumsum([len(e) for e in encoded], dtype=np.int64)
        ids = self.lone[np.concatenate([np.zeros(0, np.int32), *encoded])]
        data, borders = ids.tobytes(), (4 * ends).tolist()
        found = {s: data[a:b] for s, a, b in zip(new, [0, *borders], borders)}
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(ids < 0), "right")).tolist():
            found[new[i]] = b"".join(map(self.written.__getitem__, encoded[i].tolist()))
        kept = {s: i for s, i in found.items() if len(s) <= CACHED_LENGTH}
        self.cache |= kept
        self.held += sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY_BYTES * len(kept)
        long = found.keys() - kept.keys()
        get = (lambda s: found[s] if s in long else self.cache[s]) if long else self.cache.__getitem__
        return [b"".join(map(get, segments)) for segments in cut]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encoder(path: str) -> PieceEncoder:
    return per_process(("pieces", path), lambda: PieceEncoder(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids ARRAY<INT>, and intact
    (decoding the ids gives the text back)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)
        for batch in by_size(batches, "text"):
            texts = [t or "" for t in batch["text"].to_pylist()]
            encoded = pieces.encode(texts)
            intact = [pieces.decode(np.frombuffer(e, np.int32).tolist()) == t for e, t in zip(encoded, texts)]
            counts = [len(e) // 4 for e in encoded]
            values = pa.array(np.frombuffer(b"".join(encoded), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), ids, pa.array(intact, pa.bool_())], ["doc_id", "n_tokens", "ids", "intact"])

    docs = only(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids array<int>, intact boolean")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The contract's digests of ``encode`` without moving the ids out of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)
        decimal = pieces.decimal.__getitem__
        for batch in by_size(batches, "text"):
            counts, ids_hash, text_hash = [], [], []
            for encoded in pieces.encode([t or "" for t in batch["text"].to_pylist()]):
                ids = np.frombuffer(encoded, np.int32).tolist()
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(pieces.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
