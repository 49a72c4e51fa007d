"""Joins on group columns that may be null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows.join(groups, keys, how)`` where null is a group like any other; ``groups`` keeps its other columns."""
    named = groups.withColumnsRenamed({k: f"_g{i}_{k}" for i, k in enumerate(keys)})
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_g{i}_{k}"))
        on = same if on is None else on & same
    return rows.join(named, on, how).drop(*[f"_g{i}_{k}" for i, k in enumerate(keys)])
