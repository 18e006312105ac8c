"""Search conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches_any(text: str, columns: list[str]) -> Column:
    """Case-insensitive search in any of the columns. ``%`` and ``_`` inside the
    text stay wildcards."""
    pattern = F.lit(f"%{text}%")
    return reduce(lambda a, b: a | b, [F.ilike(F.col(c), pattern) for c in columns])
