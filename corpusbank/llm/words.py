"""Hashes of words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1_000_000  # bytes hashed together
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEP = 0x9E3779B97F4A7C15  # odd
_SPACES = b" \t\n\v\f\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(text number, piece): long texts are cut at white space."""
    for k, text in enumerate(texts):
        start = 0
        while len(text) - start > PIECE:
            end = max(text.rfind(s, start, start + PIECE) for s in map(bytes, zip(_SPACES)))
            if end < 0:  # one long word
                after = [p for s in map(bytes, zip(_SPACES)) if (p := text.find(s, start)) >= 0]
                end = min(after, default=len(text))
            yield k, text[start:end + 1]
            start = end + 1
        if start < len(text):
            yield k, text[start:]


def _hash(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each piece)."""
    raw = np.frombuffer(b"\n".join(pieces) + b"\n", dtype=np.uint8)
    solid = ~SPACE[raw]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    size = np.array([len(p) + 1 for p in pieces])
    counts = np.add.reduceat(begin, np.cumsum(size) - size, dtype=np.int64)
    letters = LOWER[raw[solid]].astype(np.uint64)
    first = np.flatnonzero(begin[solid])
    if not len(first):
        return np.zeros(0, dtype=np.uint64), counts
    length = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), STEP, dtype=np.uint64))
    value = np.add.reduceat((letters + np.uint64(1)) * power[place], first)
    return mix(value ^ mix(length.astype(np.uint64))), counts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, A-Z lower-cased, of all texts; number of words of each text)."""
    counts = np.zeros(len(texts), dtype=np.int64)
    found, held, owner, total = [], [], [], 0

    def flush():
        if held:
            values, n = _hash(held)
            found.append(values)
            np.add.at(counts, owner, n)
            held.clear()
            owner.clear()

    for k, piece in _pieces([t.encode("utf-8", "surrogatepass") for t in texts]):
        held.append(piece)
        owner.append(k)
        total += len(piece)
        if total >= PIECE:
            flush()
            total = 0
    flush()
    return np.concatenate([np.zeros(0, dtype=np.uint64), *found]), counts


def shingle_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every ``k``-word shingle, number of shingles per text).

    A text with 1 to k-1 words has its whole sequence as one shingle; one without words has none.
    """
    words, counts = word_hashes(texts)
    factor = np.uint64(STEP) * np.arange(3, 2 * k + 3, 2, dtype=np.uint64)
    sums = np.zeros(max(len(words) - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        sums += words[j:j + len(sums)] * factor[j]
    numbers = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    start = np.cumsum(counts) - counts
    at = np.repeat(start - (np.cumsum(numbers) - numbers), numbers) + np.arange(numbers.sum())
    short = np.repeat(counts < k, numbers)
    shingles = np.zeros(len(at), dtype=np.uint64)
    shingles[~short] = mix(sums[at[~short]])
    for n in range(1, k):
        own = np.flatnonzero(short)[counts[(counts > 0) & (counts < k)] == n]
        value = np.full(len(own), np.uint64(n), dtype=np.uint64)
        for j in range(n):
            value += words[at[own] + j] * factor[j]
        shingles[own] = mix(mix(value))
    return shingles, numbers
