"""Positions on a Hilbert curve, for arrays of points (Skilling's transpose method, 2004)."""

from __future__ import annotations

import numpy as np


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the curve of each row of whole coordinates in ``[0, 2**bits)``."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of the rotations, from the highest bit down
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    carried = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        carried = np.where((x[-1] & q) != 0, carried ^ (q - 1), carried)
        q >>= 1
    x ^= carried
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):  # interleave, highest bits first
        for i in range(dims):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index
