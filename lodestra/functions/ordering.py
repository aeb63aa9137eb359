"""Sort keys under which NULL is the largest value: last going up, first going down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def asc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()
