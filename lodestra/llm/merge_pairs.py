"""Which two tokens may stand side by side in a BPE encoding.

Merging joins a and b only if, at some moment, the tokens that touch their common border merge before
either is merged away from it. Those tokens run along a's right edge and b's left edge, so the answer
comes from undoing the merges along the two edges, latest first, and asking at each step whether the
touching pair has an earlier merge. Of two equal merges the left one comes first.
"""

from __future__ import annotations

from collections.abc import Callable

NEVER = 1 << 60


class PairTest:
    """rank: of the merge that makes a token (-1: a single symbol). halves: the two tokens of that merge.
    joined: the rank of the merge of two tokens, NEVER if there is none."""

    def __init__(self, rank: Callable[[int], int], halves: Callable[[int], tuple[int, int]], joined: Callable[[int, int], int], keep: int = 300_000):
        self.rank, self.halves, self.joined, self.keep = rank, halves, joined, keep
        self.known: dict[tuple[int, int], bool] = {}
        self.old: dict[tuple[int, int], bool] = {}  # the generation before, so that what is asked often stays

    def __call__(self, a: int, b: int) -> bool:
        answer = self.known.get((a, b))
        if answer is None:
            if len(self.known) >= self.keep:
                self.old, self.known = self.known, {}
            answer = self.old.get((a, b))
            answer = self.known[a, b] = self._stays(a, b) if answer is None else answer
        return answer

    def forget(self) -> None:
        self.known, self.old = {}, {}

    def _stays(self, a: int, b: int) -> bool:
        limit = NEVER
        while True:
            if self.joined(a, b) < limit:
                return False
            ra, rb = self.rank(a), self.rank(b)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.halves(a)[1]
            else:
                limit, b = rb + 1, self.halves(b)[0]
