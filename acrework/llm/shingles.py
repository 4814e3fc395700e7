"""Distinct word shingles of whole texts as 64-bit hashes, vectorised over concatenated texts."""

from __future__ import annotations

import numpy as np

from acrework.llm.common import mix64
from acrework.llm.quality_rules import words
from acrework.llm.rolling import Prefix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``size``-word shingles of each text, ascending in each, and the n + 1 bounds.

    A-Z are lower-cased; a text with fewer words has its whole sequence as one shingle; without words it has none.
    """
    data = _LOWER[data]
    n_docs = len(offsets) - 1
    start, end, doc = words(data, offsets)
    value = Prefix(data).ranges(start, end)
    n = len(doc)
    key, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= size:
        rolled = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            rolled = mix64(rolled * np.uint64(0x100000001B3) + value[k : n - size + 1 + k])
        whole = np.flatnonzero(doc[size - 1 :] == doc[: n - size + 1])
        key, owner = rolled[whole], doc[whole]
    count = np.bincount(doc, minlength=n_docs)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        at = (np.cumsum(count) - count)[few]
        rolled = count[few].astype(np.uint64)  # a short sequence never equals a full shingle
        for k in range(size - 1):
            more = count[few] > k
            rolled[more] = mix64(rolled[more] * np.uint64(0x100000001B3) + value[at[more] + k])
        key, owner = np.concatenate((key, mix64(rolled + np.uint64(1)))), np.concatenate((owner, few))
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[fresh], owner[fresh]
    return key, np.searchsorted(owner, np.arange(n_docs + 1))
