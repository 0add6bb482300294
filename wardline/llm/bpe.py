"""Byte-pair merges of many pre-tokens at once, in numpy.

The tables come from a tokenizer's own file and are made once, on the driver. All pre-tokens lie one after
another in flat arrays; a round carries out, in every pre-token that still has a known pair, its first pair
of least rank, as the tokenizer would, and drops the pre-tokens that are done.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Pre-tokens of more bytes are left to the tokenizer, whose time grows less with length.
LONGEST = 64
#: Rank of a pair that has no merge.
NONE = np.int32(2**31 - 1)


def letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


class PairTable:
    """Pairs of ids to the rank of their merge, by open addressing; `new` has the merge's id by rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, new: np.ndarray) -> None:
        self.bits, self.new = max(4, int(len(left) * 6).bit_length()), new
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys, left_over = left.astype(np.int64) << 32 | right, np.arange(len(left))
        place = self._place(keys)
        while len(left_over):
            free = left_over[self.keys[place[left_over]] < 0]
            _, first = np.unique(place[free], return_index=True)
            put = free[first]
            self.keys[place[put]], self.ranks[place[put]] = keys[put], put
            left_over = np.setdiff1d(left_over, put, assume_unique=True)
            place[left_over] = place[left_over] + 1 & (1 << self.bits) - 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for those without a merge."""
        keys = left.astype(np.int64) << 32 | right
        place = self._place(keys)
        found = self.keys[place]
        out = self.ranks[place]
        other = found != keys
        out[other] = NONE
        open_ = np.flatnonzero(other & (found >= 0))
        while len(open_):
            place[open_] = place[open_] + 1 & (1 << self.bits) - 1
            found = self.keys[place[open_]]
            same = found == keys[open_]
            out[open_[same]] = self.ranks[place[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        return out


@dataclass
class Merges:
    """A vocabulary's ids of single bytes (inside and at the end of a pre-token) and its merges."""

    inner: np.ndarray
    last: np.ndarray
    pairs: PairTable

    @staticmethod
    def of(path: str) -> Merges:
        """The tables of a byte-level BPE file, with or without a word-end suffix."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        rows = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = lambda names: np.array([vocab[n] for n in names], np.int32)
        byte = {b: c for c, b in letters().items()}
        return Merges(ids(byte[b] for b in range(256)), ids(byte[b] + end for b in range(256)), PairTable(ids(a for a, _ in rows), ids(b for _, b in rows), ids(a + b for a, b in rows)))

    def _same_length(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) of a matrix of byte ids. Each row that isn't done merges once a round, so all rows stay equally long."""
        rows, out = np.arange(len(ids)), []
        ranks = self.pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            k = np.arange(len(rows))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[k, at] if ranks.shape[1] else np.full(len(rows), NONE)
            if (over := best == NONE).any():
                out.append((rows[over], ids[over]))
                stay = ~over
                rows, ids, ranks, at, best, k = rows[stay], ids[stay], ranks[stay], at[stay], best[stay], k[: stay.sum()]
                if not len(rows):
                    break
            n, width = ids.shape
            ids[k, at] = self.pairs.new[best]
            keep = np.ones((n, width), bool)
            keep[k, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[k, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            for side in (at - 1, at):  # the pairs on either side of the merged one
                r = np.flatnonzero((side >= 0) & (side < width - 2))
                c = side[r]
                ranks[r, c] = self.pairs.rank(ids[r, c], ids[r, c + 1])
        return out

    def apply(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all tokens (large_string, none empty) one after another, and how many each has."""
        if not len(tokens):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        offsets = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
        data, lengths = np.frombuffer(tokens.buffers()[2], np.uint8), np.diff(offsets)
        order, found = np.argsort(lengths, kind="stable"), []
        for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            at = offsets[part][:, None] + np.arange(lengths[part[0]])
            ids = self.inner[data[at]]
            ids[:, -1] = self.last[data[at[:, -1]]]
            found += [(part[rows], some) for rows, some in self._same_length(ids)]
        counts = np.zeros(len(tokens), np.int64)
        for rows, some in found:
            counts[rows] = some.shape[1]
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        for rows, some in found:
            out[starts[rows][:, None] + np.arange(some.shape[1])] = some
        return out, counts
