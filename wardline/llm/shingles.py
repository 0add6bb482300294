"""Distinct word shingles of texts as 64-bit hashes, for a whole Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers that combine the hashes of a shingle's words by position.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes (uint64).

    Letters A-Z are lowered; words are runs of characters other than space and U+0009 to U+000D. A text
    of fewer words than `width`, but not none, has its whole sequence as one shingle.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    empty = words.index("") if "" in words else -1
    index, offsets = np.asarray(coded.indices), np.asarray(split.offsets)
    offsets = offsets - offsets[0]
    if empty >= 0:
        keep = index != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        index = index[keep]
    at = hashes[index]
    n = max(len(at) - width + 1, 0)
    all_ = np.zeros(n, np.uint64)
    for k in range(width):
        all_ += at[k : k + n] * _MIX[k]
    all_ = mixed(all_)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(all_[a : b - width + 1])
        elif b > a:
            yield mixed(np.array([sum(int(at[i]) * int(_MIX[i - a]) for i in range(a, b)) + b - a & 0xFFFFFFFFFFFFFFFF], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
