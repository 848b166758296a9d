"""Byte-pair encoding as a lazily compiled deterministic automaton.

A sequence of tokens is the encoding of its text exactly when each pair of neighbours is
the encoding of its own text. So every prefix of a word has one last token: among the
tokens that end there, the one compatible with the last token of the prefix before it.
What later symbols can still change is decided by the last tokens of those prefixes from
which a token may still be open. Whether two tokens are compatible is read off their merges: taken back one
by one, the latest first, no two tokens that then meet at the border may merge before what was
taken back last. A state is therefore the longest suffix that begins some
token (the matching automaton's node) with the last token, and the relative token count if
counts are asked for, at each place where a token may be open. There are finitely many
states; transitions are built on first use.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LONGEST = 48
MOST_COLUMNS = 1024
CLOSED = ("", 0)
# The last merge of a single symbol: none, before all others.
SYMBOL = (float("-inf"), "", "")


class State(dict):
    """Symbol -> (next state, length of the last token, last token, change of token count)."""

    __slots__ = ("automaton", "suffix", "window", "number")

    def __init__(self, automaton: Automaton, suffix: str, window: tuple, number: int):
        super().__init__()
        self.automaton, self.suffix, self.window, self.number = automaton, suffix, window, number

    def __missing__(self, symbol: str) -> tuple:
        step = self[symbol] = self.automaton.step(self, symbol)
        return step

    def __hash__(self):
        return id(self)

    def __eq__(self, other):
        return self is other


class Automaton:
    """``tokens``: the vocabulary, each token a string of symbols (one character each).
    ``rank(left, right)``: priority of merging two neighbours, lower first, or None.
    Without ``counts`` there are fewer states, and the counts in steps mean nothing.
    """

    def __init__(self, tokens: set[str], rank: Callable[[str, str], float | None], counts: bool = True, limit: int = 220_000):
        self.tokens, self.rank, self.counts, self.limit = tokens, rank, counts, limit
        self.open = {t[:i] for t in tokens for i in range(1, len(t))}
        self.makings: dict[str, tuple | None] = {}
        self.names: dict[str, int] = {"": 0}
        self.heads: dict[str, tuple] = {}
        self.shapes: dict[str, tuple] = {}
        self.reset()

    def reset(self) -> None:
        """Drop the compiled states (bounded memory; they are compiled again on use)."""
        self.states: dict[tuple, State] = {}
        self.listed: list[State] = []
        self.columns = np.full(0x110000, -1, np.int32)
        self.symbols: list[str] = []
        # Numbers of states, 0 where no transition is compiled yet: no transition leads to the start.
        # Pages of rows that no state has are never touched, so they take no memory.
        self.next = np.zeros((self.rows(), 64), np.int32)
        self.last, self.length = np.zeros(len(self.next), np.int32), np.zeros(len(self.next), np.int32)
        self.start = self.state("", ((None, 0),))

    def rows(self) -> int:
        return max(1024, self.limit + self.limit // 8)

    def full(self) -> bool:
        if len(self.shapes) > self.limit:
            self.shapes.clear()
        return len(self.states) > self.limit

    def state(self, suffix: str, window: tuple) -> State:
        key = (suffix, window)
        if key not in self.states:
            self.states[key] = State(self, suffix, window, len(self.listed))
            self.listed.append(self.states[key])
        return self.states[key]

    def merged(self, text: str, least: int = 1) -> list[str]:
        """The encoding by merging, as far as ``least`` parts: best rank first, leftmost among equals."""
        parts = list(text)
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank(parts[i], parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def making(self, token: str) -> tuple | None:
        """Rank and both halves of a token's last merge; None if its merges' ranks do not ascend."""
        if len(token) == 1:
            return SYMBOL
        if token not in self.makings:
            left, right = self.merged(token, 2)
            rank, halves = self.rank(left, right), (self.making(left), self.making(right))
            self.makings[token] = (rank, left, right) if all(h and h[0] < rank for h in halves) else None
        return self.makings[token]

    def compatible(self, left: str, right: str) -> bool:
        """Two tokens, each the encoding of its text, are the encoding of the text of both."""
        one, two = self.making(left), self.making(right)
        if one is None or two is None:
            return self.merged(left + right) == [left, right]
        before, also, made = float("inf"), False, self.makings
        while True:
            rank = self.rank(left, right)
            if rank is not None and (rank < before or also and rank == before):
                return False
            if one[0] > two[0]:
                before, also, left = one[0], False, one[2]
                one = made.get(left, SYMBOL)
            elif two[0] > SYMBOL[0]:  # of equal merges the leftmost comes first
                before, also, right = two[0], True, two[1]
                two = made.get(right, SYMBOL)
            else:
                return True

    def shape(self, grown: str) -> tuple:
        """What depends on the open suffix and the new symbol alone: the tokens that end
        there, the suffix that stays open, and which of its places a token may begin at."""
        if grown not in self.shapes:
            ends = [grown[-n:] for n in range(len(grown), 0, -1) if n == 1 or grown[-n:] in self.tokens]
            keep = next(i for i in range(len(grown) + 1) if i == len(grown) or grown[i:] in self.open)
            places = tuple(grown[-i:] in self.open for i in range(1, len(grown) - keep + 1))
            self.shapes[grown] = tuple((len(t), t) for t in ends if len(t) == 1 or self.merged(t) == [t]), grown[keep:], places
        return self.shapes[grown]

    def step(self, state: State, symbol: str) -> tuple:
        window = state.window
        ends, suffix, places = self.shape(state.suffix + symbol)
        for length, token in ends:
            before, count = window[length - 1]
            if before is None or self.compatible(before, token):
                break
        else:
            raise ValueError(f"no token ends {state.suffix + symbol!r}")
        if self.counts:
            moved = [(t[0], t[1] - count - 1) if held else CLOSED for t, held in zip(window, places)]
        else:
            moved = [t if held else CLOSED for t, held in zip(window, places)]
        return self.state(suffix, (self.heads.setdefault(token, (token, 0)), *moved)), length, token, count + 1

    def encode(self, word: str) -> list[str]:
        """The tokens of a word: a table of each prefix's last token, read backwards."""
        if self.full():
            self.reset()
        state, table = self.start, []
        for symbol in word:
            step = state[symbol]
            table.append(step)
            state = step[0]
        at, out = len(table), []
        while at:
            step = table[at - 1]
            out.append(step[2])
            at -= step[1]
        out.reverse()
        return out

    def column(self, symbols: np.ndarray) -> np.ndarray:
        """Table columns of symbols (code points), numbering new ones; -1 beyond the limit."""
        for code in np.unique(symbols[self.columns[symbols] < 0]):
            if len(self.symbols) < MOST_COLUMNS:
                self.columns[code] = len(self.symbols)
                self.symbols.append(chr(code))
        if len(self.symbols) > self.next.shape[1]:
            wider, used = np.zeros((len(self.next), self.next.shape[1] + 32), np.int32), len(self.listed)
            wider[:used, :self.next.shape[1]] = self.next[:used]
            self.next = wider
            return self.column(symbols)
        return self.columns[symbols]

    def compile(self, state: int, column: int) -> None:
        """Enter one transition into the table."""
        after, length, token, _ = self.step(self.listed[state], self.symbols[column])
        while after.number >= len(self.next):
            size = len(self.next)
            self.next = np.pad(self.next, ((0, size), (0, 0)))
            self.last, self.length = np.pad(self.last, (0, size)), np.pad(self.length, (0, size))
        self.next[state, column] = after.number
        self.last[after.number] = self.names.setdefault(token, len(self.names))
        self.length[after.number] = length

    def encode_many(self, words: list[str]) -> list[np.ndarray]:
        """The tokens (numbers in ``names``) of many words, stepped together through the table."""
        if self.full():
            self.reset()
        out: list = [None] * len(words)
        groups: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            groups.setdefault(len(word), []).append(i)
        for size, places in groups.items():
            codes = np.frombuffer("".join([words[i] for i in places]).encode("utf-32-le"), np.uint32).reshape(-1, size) if size else None
            columns = self.column(codes) if size and size <= LONGEST else None
            if columns is None or (columns < 0).any():
                for i in places:
                    out[i] = np.array([self.names.setdefault(t, len(self.names)) for t in self.encode(words[i])], np.int32)
                continue
            at, seen = np.zeros(len(places), np.int32), np.empty((size, len(places)), np.int32)
            for j in range(size):
                after = self.next[at, columns[:, j]]
                if not after.all():
                    missing = np.unique(np.stack([at, columns[:, j]], 1)[after == 0], axis=0)
                    for state, column in missing.tolist():
                        self.compile(state, column)
                    after = self.next[at, columns[:, j]]
                at = seen[j] = after
            found, left, lane = np.zeros((len(places), size), np.int32), np.full(len(places), size), np.arange(len(places))
            filled = np.full(len(places), size)
            while len(lane):
                state = seen[left[lane] - 1, lane]
                filled[lane] -= 1
                found[lane, filled[lane]] = self.last[state]
                left[lane] -= self.length[state]
                lane = lane[left[lane] > 0]
            for i, row, first in zip(places, found, filled.tolist()):
                out[i] = row[first:]
        return out
