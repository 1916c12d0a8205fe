"""Content-defined chunks of a record's content.

The content of a vector is a text of base-4 digits: the signs of many fixed random projections, two to a digit, so vectors at a small
angle have long stretches in common. A rolling hash over the last ``WINDOW`` digits puts a boundary wherever it is 0 modulo
``DIVISOR``; a boundary depends on these digits alone, so boundaries meet again right after a difference, an insertion or a removal. What
lies between two boundaries is cut into chunks of ``LENGTH`` digits, counted from the boundary; what is left over before the next
boundary is too short to tell contents apart and makes no chunk. A chunk's hash covers its digits and nothing else.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

DIGITS, BASE_BITS = 832, 2
#: Digits of a chunk: 26 bits. Each fourfold table of contents to be told apart wants one digit more.
LENGTH = 13
WINDOW, DIVISOR = 2, 16


@lru_cache(maxsize=2)
def projections(dim: int, digits: int) -> np.ndarray:
    return np.random.default_rng(3).standard_normal((dim, digits * BASE_BITS)).astype(np.float32)


def digits_of(vectors: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """Digits (rows, digits) of unit vectors."""
    signs = (vectors @ projections(vectors.shape[1], digits) > 0).reshape(len(vectors), digits, BASE_BITS)
    return signs[:, :, 0] + signs[:, :, 1] * np.uint32(2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def boundaries(digits: np.ndarray) -> np.ndarray:
    """Where a boundary lies behind a digit (rows, digits): a polynomial hash of the last WINDOW digits, carried on from digit to digit."""
    state, out = np.zeros(len(digits), np.uint32), np.zeros(digits.shape, bool)
    leaving = np.uint32(5 ** (WINDOW - 1))
    for i in range(digits.shape[1]):
        if i >= WINDOW:
            state = state - leaving * (digits[:, i - WINDOW] + 1)
        state = state * np.uint32(5) + digits[:, i] + 1
        if i >= WINDOW - 1:
            out[:, i] = state % np.uint32(DIVISOR) == 0
    return out


def chunks(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all chunks of the rows of ``digits``, each of LENGTH digits."""
    n, width = digits.shape
    if not n or width < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(width, dtype=np.int32)
    behind = np.maximum.accumulate(np.where(boundaries(digits), place + 1, 0), axis=1)
    begin = np.concatenate([np.zeros((n, 1), behind.dtype), behind[:, :-1]], 1)  # where the stretch that holds a digit begins
    row, end = np.nonzero((place - begin + 1) % LENGTH == 0)
    full = end + 1 - begin[row, end] >= LENGTH
    row, end = row[full], end[full]
    state = np.zeros(len(row), np.uint64)
    for k in range(LENGTH - 1, -1, -1):
        state = (state << np.uint64(BASE_BITS)) | digits[row, end - k]
    with np.errstate(over="ignore"):
        return row, _mixed(state + np.uint64(1)).view(np.int64)
