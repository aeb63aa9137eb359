"""What reused Python workers keep between tasks.

A worker serves one operator after another. Its memos (words, pieces, pairs) pay off from task to task of
one operator, but must not stay while another one runs: working() drops those of all others."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_kept: dict[str, Callable[[], None]] = {}


def _trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def working(name: str, forget: Callable[[], None] | None = None) -> None:
    """Called at the start of a task: `name` is the operator, `forget` empties its memos later."""
    others = [x for x in _kept if x != name]
    for x in others:
        _kept.pop(x)()
    if others:
        _trim()
    if forget is not None:
        _kept[name] = forget
