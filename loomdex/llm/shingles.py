"""Five-word shingle keys of whole texts, many texts at a time, in numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that part words: space and 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    got = _POWERS.get(0)
    if got is None or len(got[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _POWERS[0] = got = (np.cumprod(up), np.cumprod(down))
    return got


def word_keys(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key for each word (A-Z lower-cased) of texts laid end to end, and the number of words of each text."""
    n, texts = len(data), len(ends) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    blank = _SPACE[data]
    first = ~blank
    first[1:] &= blank[:-1]
    cut = ends[1:-1]
    cut = cut[cut < n]
    first[cut] = ~blank[cut]  # a text's first byte never goes on with the last text's word
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    up, down = _powers(n)
    value = np.where(blank, 0, _LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    stops = np.append(starts[1:], n)
    keys = mixed((total[stops] - total[starts]) * down[starts])
    counts = np.searchsorted(starts, ends[1:]) - np.searchsorted(starts, ends[:-1])
    return keys, counts


def shingle_keys(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(key, text index) of each shingle, repeats included; a text of fewer words is one shingle as a whole."""
    keys, counts = word_keys(data, ends)
    stops = np.cumsum(counts)
    starts = stops - counts
    odd = np.uint64(0xD6E8FEB86659FD93)
    out_keys, out_text = [], []
    if len(keys) >= words:
        rolled = np.zeros(len(keys) - words + 1, np.uint64)
        for j in range(words):
            rolled = rolled * odd + keys[j : len(keys) - words + 1 + j]
        text = np.repeat(np.arange(len(counts)), counts)
        inside = text[: len(rolled)] == text[words - 1 :]
        out_keys.append(mixed(rolled[inside]))
        out_text.append(text[: len(rolled)][inside])
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for j in range(words - 1):
            on = counts[few] > j
            short[on] = short[on] * odd + keys[starts[few][on] + j]
        out_keys.append(mixed(short + counts[few].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        out_text.append(few)
    if not out_keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_keys), np.concatenate(out_text)
