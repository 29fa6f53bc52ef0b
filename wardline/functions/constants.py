"""Constant tables inside expressions.

A table is written as one JSON literal that Spark folds into a constant while
planning. Spelling it out as nested ``array(struct(lit, ...))`` gives the same
constant but takes seconds to analyse for a few hundred rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(value, sql_type: str) -> Column:
    """``value`` (lists, dicts, scalars) as a constant of the given SQL type (array, map or struct)."""
    return F.from_json(F.lit(json.dumps(value)), sql_type)


def strings(values) -> Column:
    return constant(list(values), "array<string>")


def lookup(pairs: dict, key: Column, value_type: str = "string") -> Column:
    """Value of ``key`` in a constant map with string keys, else null."""
    return F.try_element_at(constant(pairs, f"map<string,{value_type}>"), key)
