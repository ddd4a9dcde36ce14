"""Growing pools of variable-length rows, gathered without per-row Python work."""

from __future__ import annotations

from itertools import repeat

import numpy as np


class Pool:
    """key -> run of integers. ``gather`` concatenates the runs of many keys."""

    def __init__(self, dtype, limit: int):
        self.dtype, self.limit = dtype, limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict = {}
        self.flat = np.empty(1 << 12, self.dtype)
        self.used = 0
        self.starts = np.empty(1 << 10, np.int64)
        self.sizes = np.empty(1 << 10, np.int64)

    def add(self, keys: list, sizes: np.ndarray, flat: np.ndarray) -> None:
        n = len(self.slot)
        self.put(n, sizes, flat)
        self.slot.update(zip(keys, range(n, n + len(keys))))

    def put(self, n: int, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Store runs at the slots from ``n`` on."""
        first, more = self.used, len(sizes)
        while n + more > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while first + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[first : first + len(flat)] = flat
        self.used += len(flat)
        self.sizes[n : n + more] = sizes
        self.starts[n : n + more] = first + np.cumsum(sizes) - sizes

    def resolve(self, keys: list, learn) -> np.ndarray:
        """Slots of the keys. ``learn`` gets the distinct ones that are not held and adds what it can; others are -1.

        A pool that would grow over its limit starts anew.
        """
        slots = self._lookup(keys)
        gone = np.flatnonzero(slots < 0).tolist()
        new = {keys[i] for i in gone}
        if len(self.slot) + len(new) > self.limit:
            self.clear()
            new, gone = set(keys), None
        if new:
            learn(list(new))
            if gone is None:
                return self._lookup(keys)
            slots[gone] = self._lookup([keys[i] for i in gone])
        return slots

    def _lookup(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(concatenated runs, size of each run)."""
        return gather(self.flat, self.starts[slots], self.sizes[slots])


class HashedPool:
    """64-bit key -> run of integers, looked up for whole arrays at once (open addressing). Key 0 is not allowed."""

    def __init__(self, dtype, limit: int):
        self.limit, self.bits = limit, max(10, int(limit * 2.2).bit_length())
        self.runs = Pool(dtype, limit)
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.count = 0
        self.runs.clear()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for those not held."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out, left = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(left):
            held = self.keys[at]
            same = held == keys[left]
            out[left[same]] = self.slots[at[same]]
            on = ~same & (held != 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Distinct new keys with the runs that stand one after the other in ``flat``."""
        slots = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        self.runs.put(self.count, sizes, flat)
        self.count += len(keys)
        at, left = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(left):
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = first & (self.keys[at] == 0)
            self.keys[at[put]], self.slots[at[put]] = keys[left[put]], slots[left[put]]
            left, at = left[~put], (at[~put] + 1) & ((1 << self.bits) - 1)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)], sizes


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each consecutive run of ``counts`` values; empty runs give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
