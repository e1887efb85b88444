"""Vectorised 64-bit hashes of words and word sequences in byte texts."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_SEED = 0xD1B54A32D192ED03


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the usual lengths are kept for the life of the worker."""
    kept = sys.__dict__.setdefault("_hash_powers", {})
    out = kept.get(base)
    if out is None or len(out) < n:
        out = np.full(max(n, 1 << 16), base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n <= 1 << 22:
            kept[base] = out
    return out[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_SEED))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every white-space-separated word of ``texts``, and the bounds of each text's words."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * powers(_BASE, len(raw)), out=sums[1:])
    words = mix((sums[last] - sums[first]) * powers(inverse(_BASE), len(raw))[first])
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return words, np.concatenate([[0], np.searchsorted(first, ends, side="right")]).astype(np.int64)


def string_hashes(strings) -> np.ndarray:
    """Hash of every string of an Arrow array (string or binary) that starts at its first place."""
    _, places, data = strings.buffers()
    if not len(strings):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(places, np.int32, len(strings) + 1).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None and ends[-1] else np.zeros(0, np.uint8)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * powers(_BASE, len(raw)), out=sums[1:])
    return mix((sums[ends[1:]] - sums[ends[:-1]]) * powers(inverse(_BASE), len(raw) + 1)[ends[:-1]])


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on (positions with fewer words left are not there)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words ^ np.uint64(_SEED)) * powers(_BASE, len(words)), out=sums[1:])
    n = len(words) - k + 1
    return mix((sums[k:] - sums[:n]) * powers(inverse(_BASE), n))


def chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive groups of texts of about ``size`` bytes, each with the index of its first."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= size):
            total += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end
