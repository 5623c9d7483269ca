"""Binary search in a sorted array column, without a join or a UDF."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F


def count_where_prefix(array: Column, holds, max_size: int) -> Column:
    """Length of the longest prefix of ``array`` whose elements satisfy
    ``holds``; the array must be ordered so that a prefix does.

    Costs log2(max_size) steps a row instead of the whole array.
    """
    steps = []
    step = 1
    while step <= max_size:
        steps.append(step)
        step *= 2
    size = F.size(array)

    def advance(found: Column, width: Column) -> Column:
        probe = found + width
        inside = probe <= size
        return F.when(
            inside & holds(F.get(array, F.least(probe, size) - 1)), probe
        ).otherwise(found)

    return F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0), advance
    )


def plan_array(values: list, element: str) -> Column:
    """A constant array that is one literal in the plan."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{element}>")
