"""Word boundaries and word hashes of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np

LONG_WORD = 1024
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply rounds) of an unsigned array."""
    h = h ^ U(seed & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for every text the index of its first word (``n + 1`` values).

    ``inside`` marks the bytes of words; by default all but white space (space and bytes 9 to 13).
    A text border always ends a word.
    """
    n = len(data)
    word = ~_SPACE[data] if inside is None else inside
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets[offsets <= n]] = True
    before = np.empty(n, dtype=bool)
    before[:1], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1:], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step; longer ones than ``LONG_WORD`` bytes through a digest."""
    length = ends - starts
    hashed = mix(length.astype(U), 0x9E3779B97F4A7C15)
    if not len(starts):
        return hashed
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    mask = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=U)
    todo = np.flatnonzero(length <= LONG_WORD)
    at = 0
    while len(todo):
        left = length[todo] - at
        chunk = eight[starts[todo] + at] & mask[np.minimum(left, 8)]
        hashed[todo] = mix(hashed[todo] + chunk, 0x2545F4914F6CDD1D)
        at += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        hashed[i] = U(int.from_bytes(digest, "little"))
    return hashed


_PLACE = mix(np.arange(1, 65, dtype=U), 0x1234567) | U(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words in each text and the offsets of the texts in them.

    A text of fewer words (but one at least) has its whole word sequence as its only run.
    """
    counts = np.diff(first)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    offsets = np.concatenate([[0], np.cumsum(runs)])
    text = np.repeat(np.arange(len(counts)), runs)
    place = first[:-1][text] + np.arange(offsets[-1]) - offsets[:-1][text]
    total = np.zeros(len(place), dtype=U)
    padded = np.concatenate([words, np.zeros(width, U)])
    last = first[1:][text]
    for k in range(width):
        total += np.where(place + k < last, padded[place + k] * _PLACE[k], U(0))
    return mix(total, 0x51ED270B), offsets


def distinct_sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted and without repeats, and the offsets of the texts in them."""
    parts, sizes = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    for i in range(len(offsets) - 1):
        part = np.sort(hashes[offsets[i]:offsets[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        parts.append(part)
        sizes[i] = len(part)
    return np.concatenate(parts) if parts else np.zeros(0, U), np.concatenate([[0], np.cumsum(sizes)])
