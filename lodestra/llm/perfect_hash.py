"""A minimal perfect hash over 128-bit keys (rows of two words), built and probed with numpy.

Level by level, every key left picks a place in a bit array; keys alone in their place stay, the others
go on to the next, smaller level (Limasset et al., 2017). A key's slot is the rank of its bit, so n distinct
keys get the slots 0..n-1. Both words pick the place, so keys that agree in one word part at the next level.
A key outside the set gets some slot or none: callers compare a fingerprint.
"""

from __future__ import annotations

import numpy as np

from lodestra.llm.kernels import mix64

_U = np.uint64
GAMMA = 1.6
LEVELS = 48


class PerfectHash:
    def __init__(self, keys: np.ndarray):
        """keys: distinct rows of two 64-bit words."""
        left, self.levels, base = keys, [], 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(GAMMA * len(left)))
            at = self._place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((size, alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            left = left[~alone[at]]
        # none in practice: keys that met others in every level
        self.rest = {tuple(k): base + i for i, k in enumerate(left.tolist())}
        self.size = base + len(left)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = mix64(np.array([level + 1], _U))
        return (mix64(mix64(keys[:, 0] ^ salt) + keys[:, 1]) % _U(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that are surely not in the set."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self._place(keys[open_], level, size)
            hit = alone[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
        if self.rest:
            out[open_] = [self.rest.get(tuple(k), -1) for k in keys[open_].tolist()]
        return out
