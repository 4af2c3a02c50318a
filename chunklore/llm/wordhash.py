"""Words of a text and their 64-bit hashes, by whole arrays."""

from __future__ import annotations

import numpy as np

#: Bytes of a word: ASCII letters, digits, the underscore, and all of a character outside ASCII.
WORD = np.array([b >= 0x80 or chr(b).isalnum() or b == 0x5F for b in range(256)])
#: Bytes of a word that ends at the ASCII blanks 20 and 09 to 0D alone.
UNBLANK = np.array([b not in b" \t\n\v\f\r" for b in range(256)])
#: Bytes hashed at a time, so that a very long text needs no more memory than its words do.
STEP = 1 << 20

_random = np.random.default_rng(20)
_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Each value's bits spread over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: bytes, of: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word in the bytes; ``of`` says of each byte whether words have it."""
    every, found = np.frombuffer(data, np.uint8), []
    at = 0
    while at < len(every):
        to = min(at + STEP, len(every))
        while to < len(every) and of[every[to - 1]] and of[every[to]]:  # never within a word
            to += 1
        part = every[at:to]
        is_word = of[part]
        edge = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        if len(start):
            first = np.concatenate([[0], np.cumsum(end - start)[:-1]])
            place = np.arange(int((end - start).sum())) - np.repeat(first, end - start)
            h = np.add.reduceat(_VALUE[part[is_word]] * _POWER[place & 4095], first)
            found.append((start + at, end + at, mixed(h)))
        at = to
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n neighbouring words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i]
    return mixed(total)
