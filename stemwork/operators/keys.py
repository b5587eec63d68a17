"""Joins in which a NULL key is a key, as it is in groups and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on equal keys, NULL with NULL; keys come from left, from either side in a full join."""
    names = {k: f"_jk{i}" for i, k in enumerate(keys)}
    rows = left.join(right.withColumnsRenamed(names), [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], how)
    if how == "full":
        rows = rows.withColumns({k: F.coalesce(F.col(k), F.col(n)) for k, n in names.items()})
    return rows if how in ("left_semi", "left_anti") else rows.drop(*names.values())
