"""64-bit XXH64 over longs: the numpy twin of the built-in xxhash64 for bigint columns."""

from __future__ import annotations

import numpy as np

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xx_longs(*columns) -> np.ndarray:
    """xxhash64(c1, c2, ...) for non-null bigint columns, as int64."""
    with np.errstate(over="ignore"):
        h: np.ndarray | np.uint64 = np.uint64(SEED)
        for c in columns:
            k = np.asarray(c, dtype=np.int64).view(np.uint64)
            x = h + _P5 + np.uint64(8)
            x = x ^ (_rotl(k * _P2, 31) * _P1)
            x = _rotl(x, 27) * _P1 + _P4
            x = (x ^ (x >> np.uint64(33))) * _P2
            x = (x ^ (x >> np.uint64(29))) * _P3
            h = x ^ (x >> np.uint64(32))
        return np.asarray(h, dtype=np.uint64).view(np.int64)
