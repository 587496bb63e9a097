"""Word shingles of texts and their hashes, as SimHash and MinHash take them."""

from __future__ import annotations

import numpy as np
import xxhash


def shingle_hashes(raw: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of words words, repeats included, A-Z lower-cased; a shorter text is one shingle, a blank one none. bytes.lower and bytes.split touch ASCII alone."""
    parts = raw.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    begins = np.concatenate([[0], ends[:-1]])[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(begins, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())
