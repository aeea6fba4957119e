"""Places of points along a Hilbert curve in any number of dimensions."""

from __future__ import annotations

import numpy as np


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """For each row of cell numbers (below ``2 ** bits``) its place on the curve, as rows of bytes in curve order.

    The curve is followed from its largest cubes down: at each level a point's lower bits are mirrored or swapped so that
    its cube looks like the first one; the Gray code of the corners then counts the cubes in curve order.
    """
    n, dims = cells.shape
    if not dims:
        return np.zeros((n, 0), np.uint8)
    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    for level in range(bits - 1, 0, -1):
        corner, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for d in range(dims):
            far = (x[d] & corner) != 0
            swap = np.where(far, np.uint32(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(far, low, swap)
            x[d] ^= swap
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    turn = np.zeros(n, np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
