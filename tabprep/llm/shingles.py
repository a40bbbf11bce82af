"""Word-shingle sets of many texts as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

SIZE = 5
#: Bytes of text that are hashed at a time.
BLOCK_BYTES = 2_000_000
_B = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_B))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each word, by prefix sums of a rolling hash."""
    inside = np.concatenate(([False], _WORD[buf], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[buf] * _powers(_B, len(buf)), dtype=np.uint64)))
    back = _powers(pow(_B, -1, 1 << 64), len(buf))
    h = (sums[ends] - sums[starts]) * back[starts] if len(starts) else np.zeros(0, np.uint64)
    return starts, mix(h + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``size``-word shingles (words of
    A-Z lower-cased letters, digits and everything beyond ASCII). A text of
    fewer words has one shingle of all of them, a text without words none."""
    out: list[np.ndarray] = []
    first = 0
    while first < len(texts):
        raw, total, last = [], 0, first
        while last < len(texts) and (last == first or total < BLOCK_BYTES):
            raw.append(texts[last].encode("utf-8", "replace").lower())
            total += len(raw[-1]) + 1
            last += 1
        buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        starts, words = _word_hashes(buf)
        ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
        cut = np.concatenate(([0], np.searchsorted(starts, ends)))
        h = np.zeros(max(len(words) - size + 1, 0), np.uint64)
        for k in range(size):
            h = h * np.uint64(_B) + words[k: len(words) - size + 1 + k]
        h = mix(h)
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a >= size:
                out.append(np.unique(h[a: b - size + 1]))
            elif b > a:
                one = 0
                for w in words[a:b].tolist():
                    one = (one * _B + w) & _MASK
                out.append(mix(np.array([one ^ int(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        first = last
    return out
