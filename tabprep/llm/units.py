"""Texts as sequences of few distinct units, for work that is done once a unit.

A unit begins at a space or line end that follows something else than white
space, and reaches to the next such place. Both kinds of tokenizers used here
(byte-level pre-tokens, pieces with a space marker) end a token at every such
place, so the tokens of a text are those of its units, one after the other. White
space is meant in its widest sense; characters that a tokenizer does not take for
white space only make units longer.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

UNIT = re.compile(r"\s++(?:\S++(?:[^\S \n]\s*+)?+)*+|(?:\S++(?:[^\S \n]\s*+)?+)++")
#: Characters of text in work at a time, and characters and units that a task remembers.
BLOCK_CHARS = 1_000_000
MAX_CHARS, MAX_UNITS = 16_000_000, 600_000


def blocks(texts: list[str], chars: int = BLOCK_CHARS):
    """Slices ``(first, last)`` of at most so many characters (or one text)."""
    return cuts(map(len, texts), chars)


def cuts(sizes, most: int):
    """Slices ``(first, last)`` of members with these sizes, of at most ``most`` together (or one member)."""
    first, last, held = 0, 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > most:
            yield first, i
            first, held = i, 0
        held += size
        last = i + 1
    if first < last:
        yield first, last


class Grown:
    """An array that doubles when it is full."""

    def __init__(self, dtype, shape: tuple = (), room: int = 0):
        self.held, self.n = np.zeros((max(64, room), *shape), dtype), 0

    def add(self, values):
        last = self.n + len(values)
        if last > len(self.held):
            more = np.zeros((max(last, 2 * len(self.held)), *self.held.shape[1:]), self.held.dtype)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n: last] = values
        self.n = last

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Ragged:
    """Lists of numbers, one per unit, in one array."""

    def __init__(self, dtype=np.int64):
        self.flat, self.first, self.size = Grown(dtype), Grown(np.int64), Grown(np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray):
        self.first.add(self.flat.n + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.flat.add(values)

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the lists of these units are, one after the other, and their sizes."""
        sizes = self.size.all[which]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.first.all[which] - (ends - sizes), sizes)
        return shift + np.arange(len(shift)), sizes


class Numbers(dict):
    """Numbers of distinct units by first sight; ``fresh`` has those not worked on yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.chars = 0

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.fresh.append(unit)
        self.chars += len(unit)
        return n

    @property
    def full(self) -> bool:
        return len(self) > MAX_UNITS or self.chars > MAX_CHARS

    def of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The units of texts that are cut already: numbers, and how many each text has."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        return np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum())), counts


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive stretches of ``counts`` members."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
