"""Circulant MinHash: shingle sets and signatures in array arithmetic.

Two permutations of the coordinates serve all hash functions. The first one breaks up the
structure of the data; the second one, circularly shifted by k, gives the k-th coordinate of a
signature: the smallest value it takes on the set. The shifts of one value lie side by side in
the table, so a shingle's values for all coordinates are one slice of it.
"""

from __future__ import annotations

import numpy as np

from tokenmill.llm.word_hashes import mix, words

#: Size of the permuted coordinate space.
SPACE = 1 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``width`` words.

    A text with fewer words has one shingle, all of it; a text without words has none.
    """
    hashes, _, first = words(data, offsets)
    out = []
    factor = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    run = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for j in range(width):
        run += hashes[j : len(run) + j] * factor[j]
    run = mix(run)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * factor[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Circulant:
    """Signatures of ``size`` coordinates from two permutations."""

    def __init__(self, size: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.first = rng.permutation(SPACE).astype(np.int32)
        second = rng.permutation(SPACE).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.append(second, second[: size - 1]), size)

    def signature(self, hashes: np.ndarray, lot: int = 512) -> np.ndarray:
        at = self.first[(hashes & np.uint64(SPACE - 1)).astype(np.int64)]
        return np.minimum.reduce([self.shifted[at[i : i + lot]].min(axis=0) for i in range(0, len(at), lot)])


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each band of the signature; equal bands at different places differ."""
    rows = signature.reshape(bands, -1).astype(np.uint64)
    total = np.arange(bands, dtype=np.uint64)
    for j in range(rows.shape[1]):
        total = mix(total * np.uint64(SPACE) + rows[:, j] + np.uint64(j + 1))
    return total
