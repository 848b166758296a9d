"""Token ids as length-delimited binary records with a separate offset index.

Every shard file is a run of records, each framed as
``length (8 bytes) | masked checksum of the length (4) | payload | masked checksum of the
payload (4)``, all little-endian. A payload is one byte with the width of an id (2 or 4)
and the ids. The checksum is CRC-32, masked by rotating it 15 bits right and adding a
constant, so that data which itself holds checksums stays well spread.

Rows are range-partitioned by (doc_id, text hash); each task writes one shard under a name
of its own attempt. The offset index is a Parquet table that Spark commits, so it names
only the files of attempts that count, and a retried task leaves no trace in it. The index
alone drives reads: any subset, in any order, can be read by seeking.

Defined cases: NULL and empty texts are records that hold only the end id; NULL ids come
first; rows with equal ids follow one another by text hash; no rows give no shard.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgrade.llm.common import by_size, only, per_process
from sparkgrade.llm.token_counts import LATIN, LATIN_WORD, Machine
from sparkgrade.session import file_system, new_table_path

MASK = 0xA282EAD8
READ_BYTES = 4 << 20
# Bytes of text that are encoded at once: the more, the fewer of their fragments are distinct.
TOGETHER = 4 << 20
# Fragments and words that a worker remembers, and the characters of the longest of them.
CACHED_FRAGMENTS, CACHED_WORDS, CACHED_LENGTH = 400_000, 500_000, 64
# Words that the library gets in one text.
JOINED = 1_000
BLANK = re.compile(r"\s")
LATIN_LOWER = re.compile("[a-zß-öø-ÿ]+")
INDEX = "shard int, record bigint, file string, offset bigint, length bigint, start bigint, n_tokens bigint"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record around a payload."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one record; ValueError if a length or checksum is wrong."""
    if len(record) < 16:
        raise ValueError("record cut short")
    length = struct.unpack_from("<Q", record)[0]
    if masked(record[:8]) != struct.unpack_from("<I", record, 8)[0] or len(record) != length + 16:
        raise ValueError("record length is damaged")
    payload = record[12:-4]
    if masked(payload) != struct.unpack_from("<I", record, len(record) - 4)[0]:
        raise ValueError("record payload is damaged")
    return payload


class WordBytes:
    """Ids of texts as bytes: the library encodes each distinct word of each distinct fragment once.

    The tokenizer drops white space and cuts words at it, so the ids of a text are those of its
    blank-separated fragments, one after another; other tokenizer files are refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # One task, one core: the library starts no threads of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        Machine.check(spec)
        if any(BLANK.search(t["content"]) for t in spec["added_tokens"]):
            raise ValueError("a special token holds a blank")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        # The same model for Latin words that are cut and lower-cased already.
        self.inner = Tokenizer.from_str(json.dumps({
            **spec, "normalizer": None, "truncation": None, "padding": None,
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][1]]},
        }))
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        suffix, special = spec["model"]["end_of_word_suffix"], {t["id"] for t in spec["added_tokens"]}
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix) and i not in special]] = True
        self.words: dict[str, bytes] = {}
        self.fragments: dict[str, bytes] = {}

    def ids(self, texts: pa.Array) -> list[memoryview]:
        """The ids of each text; a cache starts anew between calls when it is full. Only the
        distinct fragments of a call become Python objects; Arrow finds and joins them."""
        if len(self.words) > CACHED_WORDS:
            self.words = {}
        if len(self.fragments) > CACHED_FRAGMENTS:
            self.fragments = {}
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        fragments = coded.dictionary.to_pylist()
        found = list(map(self.fragments.get, fragments))
        new = [f for f, i in zip(fragments, found) if i is None]
        known = dict(zip(new, self.encode(new)))
        self.fragments.update((f, i) for f, i in known.items() if len(f) <= CACHED_LENGTH)
        ids = pa.array([known[f] if i is None else i for f, i in zip(fragments, found)], pa.binary())
        joined = ids.take(coded.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int32) if len(joined) else np.zeros(1, np.int32)
        borders = ends[cut.offsets.to_numpy()].tolist()
        data = memoryview(joined.buffers()[2] or b"")
        return [data[a:b] for a, b in zip(borders, borders[1:])]

    def encode(self, fragments: list[str]) -> list[bytes]:
        """The ids of distinct fragments, each new word through the library once."""
        plain = [f.isascii() and f.isalpha() for f in fragments]
        parts = [[f.lower()] if p else self.cut(f) for f, p in zip(fragments, plain)]
        words = list({w for part in parts for w in part} - self.words.keys())
        latin = [w for w in words if LATIN_LOWER.fullmatch(w)]
        self.words.update(zip(latin, self.joined(latin)))
        if len(latin) < len(words):
            others = [w for w in words if w not in self.words]
            self.words.update(zip(others, self.single(others)))
        out = [self.words[part[0]] if len(part) == 1 else b"".join(map(self.words.__getitem__, part)) for part in parts]
        for long in (w for w in words if len(w) > CACHED_LENGTH):
            del self.words[long]
        return out

    def single(self, words: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        return [np.array(e.ids, kind).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def joined(self, words: list[str]) -> list[bytes]:
        """The ids of words of lower-case Latin letters: many to a text, told apart by the ids that
        end a word."""
        kind, out = f"<u{self.width}", []
        for i in range(0, len(words), JOINED):
            some = words[i:i + JOINED]
            ids = np.array(self.inner.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, kind)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(cuts) != len(some):
                out += self.single(some)
                continue
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def cut(self, fragment: str) -> list[str]:
        """Words whose ids make up the fragment's: as the library cuts Latin text, else itself."""
        if LATIN.fullmatch(fragment) and "<|" not in fragment:
            return LATIN_WORD.findall(fragment.lower())
        return [fragment]


def write_records(docs: DataFrame, path: str, end_id: int, folder: str) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) into shards below ``folder``; returns the index written there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_process(("words", path), lambda: WordBytes(path))
        shard = TaskContext.get().partitionId()
        end = end_id.to_bytes(words.width, "little")
        system, base = file_system(folder)
        file, sink = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec", None
        record = offset = start = 0
        for batch in by_size(batches, "text", TOGETHER):
            rows = []
            for ids in words.ids(batch["text"]):
                framed = frame(b"".join((bytes([words.width]), ids, end)))
                if sink is None:
                    system.create_dir(f"{base}/data", recursive=True)
                    sink = system.open_output_stream(f"{base}/data/{file}")
                sink.write(framed)
                tokens = (len(framed) - 17) // words.width
                rows.append((shard, record, file, offset, len(framed), start, tokens))
                record, offset, start = record + 1, offset + len(framed), start + tokens
            if rows:
                kinds = [pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 4]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *[x.split()[0] for x in INDEX.split(", ")]])
        if sink is not None:
            sink.close()

    docs = only(docs, "doc_id", "text").withColumn("_hash", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.col("_hash")]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered.mapInArrow(run, f"doc_id {kind}, {INDEX}").write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(f"doc_id {kind}, {INDEX}").parquet(f"{folder}/index")


def payload_ids(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1)


def read_records(index: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """Read the records that ``index`` (rows of the offset index) names: its columns and ids
    ARRAY<BIGINT>, or with ``digest`` ids_crc32 (of the ids as 4 bytes each) instead."""
    def blocks(rows: list[dict]) -> Iterator[list[dict]]:
        block: list[dict] = []
        for row in rows:
            joined = block and block[-1]["file"] == row["file"] and block[-1]["offset"] + block[-1]["length"] == row["offset"]
            if block and not (joined and row["offset"] + row["length"] - block[0]["offset"] <= READ_BYTES):
                yield block
                block = []
            block.append(row)
        if block:
            yield block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        name, source = None, None
        for batch in batches:
            done = 0
            for block in blocks(batch.select(["file", "offset", "length", "n_tokens"]).to_pylist()):
                if block[0]["file"] != name:
                    if source is not None:
                        source.close()
                    name = block[0]["file"]
                    source = system.open_input_file(f"{base}/data/{name}")
                first = block[0]["offset"]
                data = source.read_at(block[-1]["offset"] + block[-1]["length"] - first, first)
                out = []
                for row in block:
                    ids = payload_ids(unframe(data[row["offset"] - first:row["offset"] - first + row["length"]]))
                    if len(ids) != row["n_tokens"]:
                        raise ValueError("index and record differ")
                    out.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype("i8"))
                last = pa.array(out, pa.int64() if digest else pa.list_(pa.int64()))
                rows = batch.slice(done, len(block))
                done += len(block)
                yield pa.RecordBatch.from_arrays([*rows.columns, last], [*rows.schema.names, "ids_crc32" if digest else "ids"])
        if source is not None:
            source.close()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(run, f"{fields}, {'ids_crc32 bigint' if digest else 'ids array<bigint>'}")


def shard_starts(index: DataFrame) -> DataFrame:
    """Ids before each shard: a running sum over one row per shard."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write all documents, read every record back: doc_id, start, n_tokens, ids_crc32."""
    spark: SparkSession = docs.sparkSession
    folder = new_table_path(spark, "records")
    index = write_records(docs, path, end_id, folder)
    read = read_records(index, folder, digest=True)
    return read.join(shard_starts(index), "shard").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32",
    )
