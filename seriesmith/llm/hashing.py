"""Vectorised 64-bit hashes of words in a text's bytes."""

from __future__ import annotations

import numpy as np

SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: One odd random number a byte and one odd base: constants of the polynomial hash.
BYTE_CODES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    step, have = np.uint64(base), 1
    with np.errstate(over="ignore"):
        while have < n:  # doubles what is there
            take = min(have, n - have)
            out[have : have + take] = out[:take] * step
            have += take
            step = step * step
    return out


_POWERS: dict[str, np.ndarray] = {}


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        _POWERS["up"], _POWERS["down"] = powers(BASE, size), powers(INVERSE, size)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each span of the bytes, from running sums of a polynomial."""
    up, down = power_table(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[data] * up[: len(data)], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word, A-Z lower-cased."""
    data = LOWER[np.frombuffer(text, dtype=np.uint8)]
    space = SPACE_BYTES[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    return span_hashes(data, starts, ends)
