"""Recursion to a fixpoint."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame

from lodestra.plans.storage import shared_dir


def fixpoint(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, ceiling: int | None = None) -> DataFrame:
    """WITH RECURSIVE: `step` sees the rows that the last round added. With `distinct` (UNION) rows already
    found are no new rows, so cycles end. Each round is cut by a checkpoint. There is no limit to the rounds but
    `ceiling`, if it is given; more are an error."""
    shared_dir(anchor.sparkSession)
    found = (anchor.distinct() if distinct else anchor).checkpoint()
    frontier, rounds = found, [found]
    for _ in range(ceiling) if ceiling is not None else itertools.count():
        new = step(frontier)
        if distinct:
            new = new.subtract(found)
        frontier = new.checkpoint()
        if frontier.isEmpty():
            return found
        rounds.append(frontier)
        found = found.unionAll(frontier)
    raise RuntimeError(f"[54P01] the recursion did not end within {ceiling} rounds")
