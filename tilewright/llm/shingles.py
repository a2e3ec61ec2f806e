"""Sets of 64-bit hashes of word shingles, computed on the bytes of whole texts.

Words are runs of bytes other than space and 0x09-0x0D after A-Z are lower-cased; a shingle is five words in a row,
or the whole sequence of a text with fewer words; a text without words has an empty set.
"""

from __future__ import annotations

import hashlib

import numpy as np

from tilewright.llm.shared import runs_of

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_PIECE = 1 << 18
_LONG_WORD = 1024
_POWERS = np.cumprod(np.concatenate([[U(1)], np.full(_LONG_WORD, U(0xD1B54A32D192ED03))]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def word_bounds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the words of texts that lie one after the other; a word ends with its text."""
    solid = ~space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    cut[ends] = True
    before = np.concatenate([[False], solid[:-1]]) & ~cut[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~cut[1:]
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def word_hashes(low: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word low[first:end]; words are hashed about a megabyte at a time."""
    out = np.empty(len(first), np.uint64)
    i = 0
    while i < len(first):
        j = min(len(first), max(i + 1, int(np.searchsorted(end, first[i] + _PIECE, "right"))))
        n = (end[i:j] - first[i:j]).astype(np.int64)
        short = n <= _LONG_WORD
        m = n[short]
        if len(m):
            edge = np.cumsum(m) - m
            place = np.arange(int(m.sum())) - np.repeat(edge, m)
            value = low[np.repeat(first[i:j][short], m) + place].astype(np.uint64) + U(1)
            got = np.add.reduceat(value * _POWERS[place], edge)
            out[i:j][short] = mix(got ^ (m.astype(np.uint64) << U(48)))
        for k in np.flatnonzero(~short):
            out[i + k] = int.from_bytes(hashlib.blake2b(low[first[i + k] : end[i + k]].tobytes(), digest_size=8).digest(), "little")
        i = j
    return out


def shingle_sets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int = 5):
    """The sorted distinct shingle hashes of each text raw[start:end]; texts lie one after the other."""
    factors = mix(np.arange(1, words + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
    for i, j in runs_of(starts, ends, _PIECE):
        base = int(starts[i])
        low = LOWER[raw[base : int(ends[j - 1])]]
        first, end = word_bounds(low, starts[i:j] - base, ends[i:j] - base, SPACE)
        h = word_hashes(low, first, end)
        a, b = np.searchsorted(first, starts[i:j] - base), np.searchsorted(first, ends[i:j] - base)
        if len(h) >= words:
            s = np.zeros(len(h) - words + 1, np.uint64)
            for k in range(words):
                s += h[k : k + len(s)] * factors[k]
            s = mix(s)
        for x, y in zip(a.tolist(), b.tolist()):
            if y - x >= words:
                yield np.unique(s[x : y - words + 1])
            elif y > x:
                yield mix(np.array([(h[x:y] * factors[: y - x]).sum(dtype=np.uint64) + U(y - x)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
