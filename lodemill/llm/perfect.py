"""Minimal perfect hash tables in numpy: n keys get the slots 0 to n - 1, and each slot holds its key.

Keys that are alone in their place of a bit array set its bit; the others try the next array. A
key's slot is the number of bits set before its own. A key that was not built in may find a bit
too; the key stored at the slot tells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lodemill.llm.common import U64, Shared, find, mix, shard_of

#: Bits for each key that is left, and arrays at most; keys left after them are stored sorted.
GAMMA, ARRAYS = 2, 24
_STEPS = np.arange(1, ARRAYS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)


def _place(hashes: np.ndarray, array: int, bits: int) -> np.ndarray:
    return (mix(hashes + _STEPS[array]) % U64(bits)).astype(np.int64)


def build(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One array of all: a head of numbers, the bits, their ranks, what is left, and the key of each slot."""
    left, words = np.arange(len(hashes)), []
    for k in range(ARRAYS):
        if not len(left):
            break
        bits = 64 * max(1, -(-GAMMA * len(left) // 64))
        at = _place(hashes[left], k, bits)
        alone = np.bincount(at, minlength=bits) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8").astype(U64))
        left = left[~alone[at]]
    every = np.concatenate(words) if words else np.zeros(0, U64)
    ones = np.bitwise_count(every).astype(np.int64)
    ranks = (np.cumsum(ones) - ones).astype(U64)
    rest = np.sort(hashes[left])
    head = np.array([len(hashes), len(words), len(rest), *[len(w) for w in words]], U64)
    table = Table(np.concatenate([head, every, ranks, rest, np.zeros(len(hashes), U64)]))
    table.keys[table.slots(hashes)] = keys
    return table.raw


class Table:
    """A built table, in memory or mapped."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.n, arrays, rest = (int(x) for x in raw[:3])
        self.sizes = [int(x) for x in raw[3 : 3 + arrays]]
        at, total = 3 + arrays, sum(self.sizes)
        self.words, self.ranks = raw[at : at + total], raw[at + total : at + 2 * total]
        self.rest = raw[at + 2 * total : at + 2 * total + rest]
        self.keys = raw[at + 2 * total + rest :]

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """A slot for each hash, right for those that were built in; -1 for some others."""
        out, left, first = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
        for k, size in enumerate(self.sizes):
            at = _place(hashes[left], k, 64 * size)
            word, bit = self.words[first + (at >> 6)], (at & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            below = np.bitwise_count(word[hit] & ((U64(1) << bit[hit]) - U64(1)))
            out[left[hit]] = self.ranks[first + (at[hit] >> 6)].astype(np.int64) + below
            left = left[~hit]
            first += size
            if not len(left):
                break
        if len(left) and len(self.rest):
            at, ok = find(self.rest, hashes[left])
            out[left[ok]] = self.n - len(self.rest) + at[ok]
        return out

    def find(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for a key that was not built in."""
        out = self.slots(hashes)
        ok = out >= 0
        ok[ok] = self.keys[out[ok]] == keys[ok]
        return np.where(ok, out, -1)


@dataclass(frozen=True)
class Tables:
    """Tables by hash range in a shared folder, numbered through: a shard's slots follow those before."""

    shared: Shared
    label: str
    starts: np.ndarray  # of each shard, and the end

    @property
    def total(self) -> int:
        return int(self.starts[-1])

    def _table(self, shard: int) -> Table:
        return Table(self.shared.mapped(f"{self.label}-{shard}", "u8"))

    def find(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The slot of each key among all, -1 for unknown ones; hashes in ascending order."""
        out, shards = np.full(len(hashes), -1, np.int64), len(self.starts) - 1
        edges = np.searchsorted(shard_of(hashes, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edges) * np.diff(self.starts)):
            part = slice(edges[s], edges[s + 1])
            got = self._table(s).find(hashes[part], keys[part])
            out[part] = np.where(got >= 0, got + self.starts[s], -1)
        return out

    def by_shard(self, slots: np.ndarray):
        """(shard, where they are wanted, slots within it) of ascending slots."""
        edges = np.searchsorted(slots, self.starts)
        for s in np.flatnonzero(np.diff(edges)):
            part = slice(edges[s], edges[s + 1])
            yield int(s), part, slots[part] - self.starts[s]

    def keys(self, slots: np.ndarray) -> np.ndarray:
        """The keys stored at some slots."""
        found, back = np.unique(slots, return_inverse=True)
        out = np.zeros(len(found), U64)
        for s, part, at in self.by_shard(found):
            out[part] = self._table(s).keys[at]
        return out[back]
