"""Hashes of words and word shingles of a text, computed for all of its bytes at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(max(n + 1, 1 << 16), base, np.uint64)
            table[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each maximal run of bytes other than ASCII white space."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def word_hashes(b: np.ndarray) -> np.ndarray:
    s, e = word_spans(b)
    up, down = _power_tables(len(b))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[b] * up[: len(b)], dtype=np.uint64)])
        return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """A hash of each k neighbouring words; of all words if there are fewer, none if there is none."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for i in range(1, k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(h + np.uint64(k))


def lowered(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode(), np.uint8)
