"""Small text kernels that run inside tasks: words, hashed windows and sets of them.

Words are `[^\\x20\\x09-\\x0D]+`, which is what bytes.split() cuts at; bytes.lower() folds A-Z only. Hashes have 64 bits: two
different windows meet with a chance of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

WHITE = b" \t\n\x0b\x0c\r"
_ODD, _EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)


def raw(column: pa.Array) -> list:
    """The values of a string column as bytes, nulls as None."""
    return column.cast(pa.large_binary()).to_pylist()


def hash_all(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, items), np.uint64, len(items))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _EVEN
    return h ^ (h >> _SHIFT)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every run of `size` neighbouring items; none if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = mixed(out * _ODD + hashes[j:j + n])
    return out


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The sorted distinct shingles of a text; fewer words than `size` make one shingle, no word makes none."""
    items = text.lower().split() if text else []
    if not items:
        return np.empty(0, np.uint64)
    return np.unique(windows(hash_all(items), min(size, len(items))))


def set_key(members: np.ndarray) -> int:
    """A signed 64-bit key of a sorted set."""
    return signed(xxh3_64_intdigest(members.tobytes(), seed=len(members)))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def subsets(members: np.ndarray, sizes: range) -> Iterator[tuple[int, int]]:
    """(size, key) of every subset whose size is in `sizes`."""
    for size in sizes:
        for part in combinations(members.tolist(), size):
            yield size, set_key(np.array(part, np.uint64))
