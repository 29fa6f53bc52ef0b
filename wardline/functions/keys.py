"""Joins on keys that may be null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Join condition of two aliased tables on key columns, where null equals null; still a hash join."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])
