"""Sets of hashed word shingles of many texts at a time, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


LETTERS = numbers(256, 1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lowered, ASCII white space between), and how many each text has."""
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    blank = BLANK[data]
    letters = np.flatnonzero(~blank)
    if not len(letters):
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.diff(letters, prepend=-2) > 1)
    place = np.arange(len(letters)) - np.repeat(first, np.diff(first, append=len(letters)))
    powers = numbers(int(place.max()) + 1, 2)
    hashes = mix(np.add.reduceat(LETTERS[data[letters]] * powers[place], first))
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(letters[first], ends)
    return hashes, np.diff(upto, prepend=0)


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles; a shorter text is one
    shingle, a text without words has none."""
    hashes, counts = word_hashes(texts)
    factors = numbers(width, 3)
    rolled = np.zeros(max(0, len(hashes) - width + 1), U)
    for k in range(width):
        rolled += hashes[k : len(hashes) - width + 1 + k] * factors[k]
    rolled = mix(rolled)
    at = 0
    for n in counts.tolist():
        if n >= width:
            yield np.unique(rolled[at : at + n - width + 1])
        elif n:
            yield mix((hashes[at : at + n] * factors[:n]).sum(keepdims=True, dtype=U) + U(n))
        else:
            yield np.zeros(0, U)
        at += n
