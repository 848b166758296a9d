"""Token counts by a tokenizer compiled into deterministic transducers.

The tokenizer (lower case, white space dropped, words cut by character class, byte-level
BPE with word ends) is one lazily compiled machine over characters. Its transitions carry
the number of tokens they emit; the token count of a text is their sum. The last symbol of
an open word is held back, since it becomes a word-end symbol when the word ends.

A text is cut into chunks. The state map of a chunk says what the chunk does from any entry
state: up to its first blank it depends on that state, which is kept as the open fragment
(head); from there the machine is in its start state, so the count to the last blank is
known; the rest (tail) is the exit state, as the open word. Maps compose associatively, and
a parallel prefix scan over the maps gives the tokens before every chunk border.

Defined cases: a NULL or empty text has no tokens; every input row gives one row; other
input columns are ignored; strings of special tokens inside a text are one token each.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkgrade.llm.bpe import Automaton, State
from sparkgrade.llm.common import BoundedCache, only, per_process

CHUNK = 16_384
CACHED_FRAGMENTS = 300_000
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = {"r": "e", "v": "e", "l": "l"}
FINAL = 0xF0000
LATIN = re.compile("[!-~À-ÿ]*")
LATIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


END = {chr(c): chr(FINAL + c) for c in range(512)}


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Node(dict):
    """A machine state: character -> (next state, tokens emitted)."""

    __slots__ = ("machine", "kind", "inner", "held")

    def __init__(self, machine: Machine, kind: str, inner: State, held: str):
        super().__init__()
        self.machine, self.kind, self.inner, self.held = machine, kind, inner, held

    def __missing__(self, char: str) -> tuple[Node, int]:
        found = self[char] = self.machine.compile(self, char)
        return found


class Machine:
    """The transducer of one tokenizer file; without ``counts`` it only encodes."""

    def __init__(self, path: str, counts: bool = True, limit: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.check(spec)
        self.library, self.limit = Tokenizer.from_file(path), limit
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.symbols = byte_symbols()
        suffix = spec["model"]["end_of_word_suffix"]

        def symbolic(token: str) -> str:
            if token.endswith(suffix):
                token = token.removesuffix(suffix)
                return token[:-1] + chr(FINAL + ord(token[-1]))
            return token

        ranks = {(symbolic(a), symbolic(b)): i for i, (a, b) in enumerate(spec["model"]["merges"])}
        self.ids = {symbolic(t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        self.automaton = Automaton(set(self.ids), lambda a, b: ranks.get((a, b)), counts)
        self.ids |= {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.classes: dict[str, str] = {}
        self.reset()

    @staticmethod
    def check(spec: dict) -> None:
        """Refuse tokenizer files of another build than the machine compiles."""
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        model = spec["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if (
            steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or not plain
            or cuts[0]["pattern"] != {"Regex": WORD_SPLIT} or not cuts[0]["invert"] or cuts[1]["add_prefix_space"]
            or model["type"] != "BPE" or not model["end_of_word_suffix"]
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        ):
            raise ValueError("a lower-casing byte-level BPE tokenizer with word ends is needed")

    def reset(self) -> None:
        """Drop the compiled states (bounded memory; they are compiled again on use)."""
        self.nodes: dict[tuple, Node] = {}
        self.automaton.reset()
        self.fragments = BoundedCache(self.walk, CACHED_FRAGMENTS)
        self.id_table = np.zeros(0, np.int64)
        self.start = self.node("start", self.automaton.start, "")

    def node(self, kind: str, inner: State, held: str) -> Node:
        key = (kind, id(inner), held)
        if key not in self.nodes:
            self.nodes[key] = Node(self, kind, inner, held)
        return self.nodes[key]

    def kind(self, char: str) -> str:
        """The class of a character, as the library's own steps treat it."""
        if char not in self.classes:
            cut = self.library.pre_tokenizer.pre_tokenize_str
            if not cut(char):
                found = "space"
            elif len(cut(char + char)) == 2:
                found = "number"
            else:
                found = "letters" if len(cut("a" + char)) == 1 else "other"
            self.classes[char] = found
        return self.classes[char]

    def feed(self, inner: State, held: str, char: str) -> tuple[State, str, int]:
        emitted = 0
        for byte in char.encode():
            if held:
                inner, _, _, change = inner[held]
                emitted += change
            held = self.symbols[byte]
        return inner, held, emitted

    def finish(self, node: Node) -> int:
        """Tokens still to come when a word or the text ends in ``node``."""
        if not node.held:
            return 0
        if node.kind in LONG_ENDINGS:
            return self.word("'") + self.word(node.kind)
        return node.inner[chr(FINAL + ord(node.held))][3]

    def word(self, text: str) -> int:
        inner, held, emitted = self.feed(self.automaton.start, "", text)
        return emitted + inner[chr(FINAL + ord(held))][3]

    def compile(self, node: Node, char: str) -> tuple[Node, int]:
        emitted = 0
        for low in self.library.normalizer.normalize_str(char):
            node, more = self.move(node, low)
            emitted += more
        return node, emitted

    def move(self, node: Node, char: str) -> tuple[Node, int]:
        kind = self.kind(char)
        if node.kind == "apostrophe":
            if char in SHORT_ENDINGS:
                return self.start, self.word("'" + char)
            if char in LONG_ENDINGS:
                return self.node(char, node.inner, node.held), 0
        elif node.kind in LONG_ENDINGS:
            if char == LONG_ENDINGS[node.kind]:
                return self.start, self.word("'" + node.kind + char)
            open_word, _ = self.move(self.start, node.kind)
            after, emitted = self.move(open_word, char)
            return after, self.word("'") + emitted
        if kind == node.kind or kind == "other" and node.kind == "apostrophe":
            inner, held, emitted = self.feed(node.inner, node.held, char)
            return self.node(kind, inner, held), emitted
        ended = self.finish(node)
        if kind == "space":
            return self.start, ended
        if kind == "number":
            return self.start, ended + self.word(char)
        inner, held, emitted = self.feed(self.automaton.start, "", char)
        return self.node("apostrophe" if char == "'" else kind, inner, held), ended + emitted

    def walk(self, fragment: str) -> int:
        """Tokens of a text that starts and ends outside a word."""
        node, total = self.start, 0
        for char in fragment:
            node, emitted = node[char]
            total += emitted
        return total + self.finish(node)

    def run(self, text: str) -> int:
        """``walk``, in which every blank leads back to the start state: the sum over the
        fragments between blanks, of which repeated ones are remembered."""
        return sum(map(self.fragments.__getitem__, text.replace("\n", " ").split(" ")))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """The ids of texts one after another, and where each text's ids end: words as the
        library cuts them, all through the automaton's table."""
        words, owners, specials = [], [], {}
        for text in texts:
            at = 0
            for found in self.special.finditer(text) if "<|" in text else ():
                words += self.words(text[at:found.start()])
                specials[len(words)] = found.group()
                words.append("")
                at = found.end()
            words += self.words(text[at:])
            owners.append(len(words))
        parts = self.automaton.encode_many([w[:-1] + END[w[-1]] if w else "" for w in words])
        names = self.automaton.names
        for i, special in specials.items():
            parts[i] = np.array([names.setdefault(special, len(names))])
        if len(self.id_table) < len(names):
            self.id_table = np.array([self.ids.get(n, 0) for n in names], np.int64)
        if not parts:
            return np.zeros(0, np.int64), owners
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return self.id_table[np.concatenate(parts)], ends[owners].tolist()

    def words(self, part: str) -> list[str]:
        """The words of a text in byte symbols."""
        if part.isascii() and part.isalpha():
            return [part.lower()]
        if LATIN.fullmatch(part):
            return ["".join([self.symbols[b] for b in w.encode()]) for w in LATIN_WORD.findall(part.lower())]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]


class ChunkMap(NamedTuple):
    """What a chunk does to any entry state; ``tail`` None: no blank, so only a fragment."""

    head: str
    count: int
    tail: str | None


def chunk_map(machine: Machine, chunk: str) -> ChunkMap:
    first = re.search(r"[ \n]", chunk)
    if first is None:
        return ChunkMap(chunk, 0, None)
    last = max(chunk.rfind(" "), chunk.rfind("\n"))
    return ChunkMap(chunk[:first.start()], machine.run(chunk[first.start():last + 1]), chunk[last + 1:])


def compose(machine: Machine, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    if a.tail is None:
        return ChunkMap(a.head + b.head, b.count, b.tail)
    if b.tail is None:
        return ChunkMap(a.head, a.count, a.tail + b.head)
    return ChunkMap(a.head, a.count + machine.run(a.tail + b.head) + b.count, b.tail)


def scan(maps: list, join: Callable[[Any, Any], Any]) -> list:
    """Inclusive prefix scan in pairs: logarithmic depth, linear work."""
    if len(maps) < 2:
        return maps
    pairs = scan([join(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)], join)
    return [pairs[i // 2] if i % 2 else maps[0] if i == 0 else join(pairs[i // 2 - 1], maps[i]) for i in range(len(maps))]


def border_counts(machine: Machine, text: str, chunk: int = CHUNK) -> list[int]:
    """Tokens of the text up to each chunk border; the last is the count of the whole text."""
    if len(machine.nodes) > machine.limit or machine.automaton.full():
        machine.reset()
    counts, base, at = [], 0, 0
    for found in [*machine.special.finditer(text), None]:
        part = text[at:found.start()] if found else text[at:]
        if not unicodedata.is_normalized("NFC", part):
            part = unicodedata.normalize("NFC", part)
        maps = [chunk_map(machine, part[i:i + chunk]) for i in range(0, len(part), chunk)]
        for m in scan(maps, lambda a, b: compose(machine, a, b)):
            counts.append(base + machine.run(m.head) + m.count + machine.run(m.tail or ""))
        base = (counts[-1] if maps else base) + bool(found)
        at = found.end() if found else at
    return [*counts, base]


def machine(path: str, counts: bool = True) -> Machine:
    return per_process(("machine", path, counts), lambda: Machine(path, counts))


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit, and
    border_tokens (tokens before each chunk border, for cutting long texts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = machine(path)
        for batch in batches:
            sizes, borders = [], []
            for value in batch["text"]:
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                borders.append(border_counts(compiled, text, chunk))
            totals = [b[-1] for b in borders]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()),
                    pa.array([t > limit for t in totals], pa.bool_()), pa.array(borders, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "border_tokens"],
            )

    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, border_tokens array<bigint>")
