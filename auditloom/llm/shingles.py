"""Sets of word shingles and their MinHash signatures, for many texts at once."""

from __future__ import annotations

import numpy as np

from auditloom.llm.textarrays import Texts, mix, windows

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of ``size``-word shingles; those of text i are values[marks[i]:marks[i + 1]].

    A-Z are lower-cased. A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    lowered = Texts(LOWER[texts.data], texts.offsets)
    words = lowered.words()
    hashes, counts = lowered.hashes(words), words.counts()
    values, first = windows(hashes, words.marks, size)
    owner = words.owner()[first] if len(first) else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            more = counts[short] > k
            whole[more] = mix(whole[more] + hashes[words.marks[short[more]] + k] + np.uint64(977 * size))
        values, owner = np.concatenate([values, whole]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    else:
        values = values.copy()
    marks = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(marks[:-1], marks[1:], strict=True):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], np.searchsorted(owner[fresh], np.arange(len(texts) + 1))


def minima(values: np.ndarray, marks: np.ndarray, hashes: int, seed: int) -> np.ndarray:
    """The minimum of each universal hash a x + b over each set that isn't empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)
    starts = marks[:-1][np.diff(marks) > 0]
    out = np.empty((len(starts), hashes), np.uint64)
    work = np.empty_like(values)
    for k in range(hashes):
        np.multiply(values, a[k], out=work)
        np.add(work, b[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts) if len(starts) else 0
    return out
