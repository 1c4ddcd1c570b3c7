"""Word shingles as 64-bit hashes, computed on UTF-8 bytes of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SHINGLE = 5
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_R = np.uint64(29)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles(data: bytes | None) -> np.ndarray:
    """Hash of each 5-word shingle in text order (A-Z lower-cased; words by ASCII white space).

    Fewer than five words make one shingle of all of them; no words make none.
    """
    found = (data or b"").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    k = min(SHINGLE, n)
    h = w[: n - k + 1] * _M1 + np.uint64(k)
    for i in range(1, k):
        h = ((h ^ (h >> _R)) * _M1) ^ w[i : n - k + 1 + i]
    return mixed(h)


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted values, each once."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def arrow_rows(batches, *columns: int) -> Iterator[tuple]:
    """Rows of Arrow batches as Python values, a bounded slice at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*[part.column(i).to_pylist() for i in columns], strict=True)


def at_least(percent: int, n: int) -> int:
    """The least whole number that is percent % of n or more."""
    return -(-percent * n // 100)
