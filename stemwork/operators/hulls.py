"""Convex hulls of groups of places, from partial hulls that merge."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def ring(points: list[tuple[float, float, object]]) -> list[tuple[float, float, object]]:
    """Corners of the hull of (x, y, name), counter-clockwise from the leftmost (of these the lowest); places on an edge are no corners, and of names at one place the least stays."""
    firsts: dict[tuple[float, float], object] = {}
    for x, y, name in points:
        firsts[x, y] = min(firsts.get((x, y), name), name)
    some = sorted((x, y, name) for (x, y), name in firsts.items())
    if len(some) < 3:
        return some

    def half(run: list) -> list:
        out: list = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(some) + half(some[::-1])


def convex_hulls(points: DataFrame, keys: list[str], point: str = "point") -> DataFrame:
    """(keys, corner, point, x, y): corners of each group's hull, numbered from 1 counter-clockwise from the leftmost.

    Each batch of rows sends the corners of its own hulls, so a group of any size meets as few rows as its batches have corners.
    Rows without a place count for nothing; groups of one or two places have these as corners.
    """
    rows = points.where("x is not null and y is not null").select(*keys, F.col(point).alias("point"), F.col("x").cast("double"), F.col("y").cast("double"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def corners(group: pd.DataFrame) -> pd.DataFrame:
        found = ring(list(zip(group.x, group.y, group.point, strict=True)))
        out = pd.DataFrame(found, columns=["x", "y", "point"])
        for k in keys:
            out[k] = [group[k].iloc[0]] * len(out)
        return out[[*keys, "point", "x", "y"]]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [corners(group) for _, group in batch.groupby(keys, dropna=False)] if keys else [corners(batch)] * bool(len(batch))
            yield pd.concat(found) if found else batch.iloc[:0]

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        out = corners(group)
        return out.assign(corner=range(1, len(out) + 1))[[*keys, "corner", "point", "x", "y"]]

    return rows.mapInPandas(partial, kinds).groupBy(*keys).applyInPandas(whole, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.select(*keys).schema)}{', ' if keys else ''}corner int, point {rows.schema['point'].dataType.simpleString()}, x double, y double")


def hull_area(hulls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, corners, area) of convex_hulls()."""
    following = hulls.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col("corner").alias("_c"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    n = hulls.groupBy(*[F.col(k).alias(f"_n{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n"))
    sized = hulls.join(n, [F.col(k).eqNullSafe(F.col(f"_n{i}")) for i, k in enumerate(keys)])
    pairs = sized.join(following, [*(F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)), F.col("_c") == F.col("corner") % F.col("_n") + 1])
    return pairs.groupBy(*keys).agg(F.count("*").alias("corners"), (F.sum(F.col("x") * F.col("_y") - F.col("_x") * F.col("y")) / 2).alias("area"))
