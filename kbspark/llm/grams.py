"""Sets of hashed word n-grams of whole texts."""

from __future__ import annotations

import numpy as np

from .words import each, mixed

SHINGLE = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles of a whole text, ascending."""
    found: list[np.ndarray] = []
    each([text], lambda _, w: found.append(w.hashes), fold=True)
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    size = min(len(words), shingle)
    if not size:
        return words
    h = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        h = mixed(h * _STEP + words[i : i + len(h)])
    return np.unique(h)
