"""Vectorised word and shingle hashes, the same in every process."""

from __future__ import annotations

import numpy as np

GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A full 64-bit mix (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x + GOLD
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    place = (np.arange(len(points)) - np.repeat(start, size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(points * GOLD + place), start))


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owners) of all runs of ``n`` lower-case words; a text of fewer words
    has one shingle of all of them, one without words has none."""
    number: dict[str, int] = {}
    put = number.setdefault
    words = [t.lower().split() if t else [] for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((put(w, len(number)) for ws in words for w in ws), np.int64, int(size.sum()))
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = word_hashes(list(number))[flat]
    count = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
    owner = np.repeat(np.arange(len(words)), count)
    first = np.repeat(np.cumsum(size) - size, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    last = (np.cumsum(size))[owner]
    h = np.zeros(len(owner), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            at = first + k
            h = mix(h * MIX2 + np.where(at < last, word[np.minimum(at, len(word) - 1)], np.uint64(k)))
    return h, owner


def counted(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) with counts, by owner and hash."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], owner[first], np.diff(np.append(first, len(h)))
