"""First, last and top rows inside groups, as mergeable aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_by(value: str, *order: str) -> Column:
    return F.min_by(F.col(value), F.struct(*order))


def last_by(value: str, *order: str) -> Column:
    return F.max_by(F.col(value), F.struct(*order))


def last_row(*cols: str, order: tuple[str, ...]) -> Column:
    """The newest row of the group as a struct."""
    return F.max_by(F.struct(*cols), F.struct(*order))
