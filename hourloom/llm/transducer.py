"""Minimal acyclic transducers: sorted words to their ordinals, in arrays that a task can walk for many words at once."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import takewhile
from typing import NamedTuple

import numpy as np


class Transducer(NamedTuple):
    """Transitions by (state, byte), each with the state it leads to and what it adds to the ordinal.

    A transition adds the number of words that leave its state before it in byte order, so that the sum along a word
    is the word's place among all words, in byte order and from 0.
    """

    root: int
    size: int
    keys: np.ndarray  # state << 8 | byte, ascending
    targets: np.ndarray
    adds: np.ndarray
    final: np.ndarray

    def parts(self) -> tuple:
        return (self.root, self.size, *(x.tobytes() for x in self[2:]))

    @classmethod
    def of(cls, root: int, size: int, *parts: bytes) -> Transducer:
        return cls(root, size, *(np.frombuffer(x, dtype=t) for x, t in zip(parts, (np.int64, np.int32, np.int64, np.bool_))))

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """The ordinal of each word, -1 for others; all words go one byte further at a time."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        at = np.cumsum(lengths) - lengths
        ends, out = at + lengths, np.zeros(len(words), dtype=np.int64)
        state = np.full(len(words), self.root, dtype=np.int64)
        live = np.flatnonzero(at < ends)
        while len(live) and len(self.keys):
            key = state[live] << 8 | data[at[live]]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[place] == key
            out[live[~known]] = -1
            live, place = live[known], place[known]
            state[live], at[live] = self.targets[place], at[live] + 1
            out[live] += self.adds[place]
            live = live[at[live] < ends[live]]
        out[live] = -1
        return np.where((out >= 0) & self.final[state], out, -1)

    def word(self, ordinal: int) -> bytes:
        """The word of an ordinal."""
        if not 0 <= ordinal < self.size:
            raise IndexError(ordinal)
        word, state = bytearray(), self.root
        while True:
            if self.final[state]:
                if ordinal == 0:
                    return bytes(word)
            first, last = np.searchsorted(self.keys, [state << 8, (state + 1) << 8])
            k = first + int(np.searchsorted(self.adds[first:last], ordinal, "right")) - 1
            word.append(int(self.keys[k]) & 255)
            ordinal -= int(self.adds[k])
            state = int(self.targets[k])


class Builder:
    """Takes words in ascending byte order.  States behind the current word are settled: equal ones, with the same words after them, are one."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.below: list[int] = []  # words from each state on
        self.final: list[bool] = []
        self.keys: list[int] = []
        self.targets: list[int] = []
        self.adds: list[int] = []
        self.last: bytes | None = None
        self.open: list[tuple[list[bool], list]] = [([False], [])]
        self.size = 0

    def add(self, word: bytes) -> None:
        if self.last is not None and word <= self.last:
            raise ValueError("words must ascend")
        shared = sum(1 for _ in takewhile(lambda pair: pair[0] == pair[1], zip(word, self.last or b"")))
        self._settle(shared)
        self.open += [([False], []) for _ in range(len(word) - shared)]
        self.open[-1][0][0] = True
        self.last, self.size = word, self.size + 1

    def _settle(self, depth: int) -> None:
        while len(self.open) > depth + 1:
            state = self._state(*self.open.pop())
            self.open[-1][1].append((self.last[len(self.open) - 1], state))

    def _state(self, final: list[bool], edges: list[tuple[int, int]]) -> int:
        shape = (final[0], *edges)
        state = self.known.get(shape)
        if state is None:
            state = self.known[shape] = len(self.below)
            n = int(final[0])
            for byte, target in edges:
                self.keys.append(state << 8 | byte)
                self.targets.append(target)
                self.adds.append(n)
                n += self.below[target]
            self.below.append(n)
            self.final.append(final[0])
        return state

    def done(self) -> Transducer:
        self._settle(0)
        root = self._state(*self.open[0])
        return Transducer(root, self.size, np.array(self.keys, np.int64), np.array(self.targets, np.int32), np.array(self.adds, np.int64), np.array(self.final, np.bool_))


def build(words: Iterable[bytes]) -> Transducer:
    builder = Builder()
    for word in words:
        builder.add(word)
    return builder.done()
