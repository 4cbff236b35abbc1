"""Number arrays as compressed cells, and keys dealt to buckets by their value."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=1)
def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(raw: bytes) -> bytes:
    return _codec()[0].compress(raw)


def expand(cell: bytes) -> bytes:
    return _codec()[1].decompress(cell)


def pack(values: np.ndarray) -> bytes:
    """Compress an array with its bytes of equal weight side by side."""
    values = np.ascontiguousarray(values)
    return squeeze(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpack(cell: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(expand(cell), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Compress sorted unsigned keys by their differences."""
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(cell: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(cell, dtype), dtype=dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_bounds(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Ends of the runs of sorted keys below ``2**bits`` that go to each of ``buckets`` equal ranges."""
    edges = np.array([(i << bits) // buckets for i in range(1, buckets)], dtype=np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]
