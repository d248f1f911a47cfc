"""Counter-based random numbers: values depend on their coordinates, never on partitions."""

from __future__ import annotations

import numpy as np


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of coordinates, broadcast against each other."""
    out = np.zeros(1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            x = np.asarray(p).astype(np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
            out = (out ^ x) * np.uint64(0xFF51AFD7ED558CCD)
            out = (out ^ (out >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            out = out ^ (out >> np.uint64(29))
    return out
