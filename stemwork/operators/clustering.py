"""Clusters of apexes across detectors or blocks, operating points of their fusion, and credits."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from stemwork.functions.scalars import CHM_ARMS
from stemwork.sources.scratch import checkpointed

from . import matching, spatial
from .keys import joined


def components(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str = "point", rounds: bool = False) -> DataFrame:
    """nodes with cluster, the least node that edges (keys, a, b) connect them to.

    A cell's edges are joined in one Arrow group, which suits cells that are plots. For cells whose edges don't
    fit a task there are rounds: labels spread along edges and each round also jumps to the label's label, so
    paths take a number of rounds that is logarithmic in their length; every round is checkpointed.
    """
    names = {k: f"_c{i}" for i, k in enumerate(keys)}
    labels = (_spread(nodes, edges, keys, node) if rounds else _joined(edges, keys)).withColumnsRenamed(names)
    on = [*[F.col(k).eqNullSafe(F.col(c)) for k, c in names.items()], F.col(node) == F.col("n")]
    return nodes.join(labels, on, "left").withColumn("cluster", F.coalesce("l", node)).drop(*names.values(), "n", "l")


def _joined(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, l) of the nodes of edges, by union of sets that keep their least node."""
    rows = edges.select(*keys, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))

    def kernel(cell: pd.DataFrame) -> pd.DataFrame:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.setdefault(x, x)) != x:
                above[x] = x = above.setdefault(y, y)
            return x

        for x, y in zip(cell.a.tolist(), cell.b.tolist(), strict=True):
            x, y = top(x), top(y)
            above[max(x, y)] = min(x, y)
        nodes = list(above)
        return pd.DataFrame({**{k: [cell[k].iloc[0]] * len(nodes) for k in keys}, "n": nodes, "l": [top(x) for x in nodes]})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.groupBy(*keys).applyInPandas(kernel, f"{kinds}, n long, l long")


def _spread(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str) -> DataFrame:
    """(keys, n, l) of all nodes, in rounds."""
    both = edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b"), F.col("a"))).distinct().checkpoint()
    now = nodes.select(*keys, F.col(node).alias("n"), F.col(node).alias("l")).checkpoint()
    while True:
        near = both.join(now.select(*keys, F.col("n").alias("b"), "l"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("n")).agg(F.min("l").alias("m"))
        low = now.join(near, [*keys, "n"], "left").select(*keys, "n", F.least("l", "m").alias("l2"), "l")
        jump = low.select(*keys, F.col("n").alias("l2"), F.col("l2").alias("j"))
        after = low.join(jump, [*keys, "l2"], "left").select(*keys, "n", F.least("l2", "j").alias("l2"), "l").checkpoint()
        done = after.where("l2 <> l").isEmpty()
        now = after.select(*keys, "n", F.col("l2").alias("l"))
        if done:
            return now


def links(apexes: DataFrame, keys: list[str], tol: float, dz: float, per: float = 48.0, least: int = spatial.FEW_PAIRS) -> DataFrame:
    """(keys, a, b) that connect apexes as all pairs of different arms within tol and dz do; all of those where they are few.

    Where apexes are dense, near pairs are joined first. What then hangs together most in each group needs no further pairs
    within itself, so farther ones are sought for the other apexes alone, and only the clusters that they join are kept.
    """
    some = apexes.select(*keys, "point", "arm", "x", "y", "z")
    reach = spatial.sparse_reach(some, some, keys, tol, per, least)
    if reach >= tol:
        return spatial.pairs_within(apexes, tol, keys, "point", apart="arm", dz=dz)
    some = checkpointed(some)
    found = checkpointed(spatial.pairs_within(some, reach, keys, "point", apart="arm", dz=dz))
    while reach < tol:
        placed = checkpointed(components(some, found, keys))
        sizes = placed.groupBy(*keys, "cluster").agg(F.count("*").alias("_n"))
        largest = sizes.groupBy(*keys).agg(F.max_by("cluster", F.struct("_n", "cluster")).alias("cluster"))
        rest = checkpointed(joined(placed, largest, [*keys, "cluster"], "left_anti"))
        reach = min(tol, max(1.5 * reach, spatial.sparse_reach(rest, placed, keys, tol, per, least)))
        apart = (F.col("arm") != F.col("r_arm")) & (F.abs(F.col("z") - F.col("r_z")) <= dz) & (F.col("cluster") != F.col("r_cluster"))
        met = spatial.within(rest, placed, reach, keys, extra=apart, turned=True).select(*keys, F.col("cluster").alias("a"), F.col("r_cluster").alias("b")).distinct()
        found = checkpointed(found.unionByName(met))
    return found


def fuse(apexes: DataFrame, keys: list[str], tol: float = 2.0, dz: float = 5.0) -> DataFrame:
    """(keys, cluster, x, y, z, votes, arms): single-linkage clusters of apexes of different arms.

    apexes: keys, point, arm, x, y, z. The highest member stands for a cluster (ties: the first), votes are
    its distinct arms. Apexes of one arm meet only through another arm's.
    """
    rows = components(apexes, links(apexes, keys, tol, dz), keys)
    top = F.max_by(F.struct("x", "y", "z"), F.struct("z", -F.col("point")))
    arms = F.array_sort(F.collect_set("arm"))
    out = rows.groupBy(*keys, "cluster").agg(top.alias("t"), arms.alias("a"))
    return out.select(*keys, "cluster", "t.x", "t.y", "t.z", F.size("a").cast("long").alias("votes"), F.array_join("a", ",").alias("arms"))


def operating_points(apexes: DataFrame, keys: list[str], n_arms: int, tol: float = 2.0, dz: float = 5.0, surface: tuple[str, ...] = CHM_ARMS, share: float = 0.5) -> DataFrame:
    """(keys, mode, x, y, z, votes) for union, majority (at least half the arms) and layered.

    layered fuses the surface arms' apexes from `share` of the cell's greatest height up with the other arms'
    below it.
    """
    every = fuse(apexes, keys, tol, dz)
    top = apexes.groupBy(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)]).agg((share * F.max("z")).alias("_split"))
    upper = F.col("arm").isin(*surface)
    kept = apexes.join(top, [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(keys)]).where((upper & (F.col("z") >= F.col("_split"))) | (~upper & (F.col("z") < F.col("_split"))))
    layered = fuse(kept.select(*apexes.columns), keys, tol, dz)
    pick = lambda df, mode: df.select(*keys, F.lit(mode).alias("mode"), "x", "y", "z", "votes")
    return pick(every, "union").union(pick(every.where(F.col("votes") >= math.ceil(n_arms / 2)), "majority")).union(pick(layered, "layered"))


def frontier(fused: DataFrame, keys: list[str], n_arms: int) -> DataFrame:
    """(keys, k, n) for k from 1 to n_arms: clusters with at least k votes."""
    ks = F.explode(F.sequence(F.lit(1), F.lit(n_arms)))
    return fused.select(*keys, "votes").withColumn("k", ks).groupBy(*keys, "k").agg(F.count_if(F.col("votes") >= F.col("k")).alias("n"))


def instance_apexes(points: DataFrame, keys: list[str], label: str = "inst") -> DataFrame:
    """(keys, label, x, y, z) of the highest point of each label, the first of equal ones; 0 and NULL are no label.

    points: keys, point, label, x, y, z.
    """
    some = points.where(F.col(label).isNotNull() & (F.col(label) != 0))
    out = some.groupBy(*keys, label).agg(F.max_by(F.struct("x", "y", "z"), F.struct("z", -F.col("point"))).alias("t"))
    return out.select(*keys, label, "t.x", "t.y", "t.z")


def merge_blocks(points: DataFrame, keys: list[str], tol: float = 2.0) -> DataFrame:
    """Labelled points with global_id, counted from 1 in a cell, common to labels of different blocks whose
    apexes lie within tol. points: keys, point, block, inst, x, y, z."""
    apex = instance_apexes(points, [*keys, "block"], "inst")
    apex = apex.withColumn("point", F.row_number().over(W.partitionBy(*keys).orderBy("block", "inst")))
    groups = components(apex, spatial.pairs_within(apex, tol, keys, "point", apart="block"), keys)
    ids = groups.select(*keys, "block", "inst", F.dense_rank().over(W.partitionBy(*keys).orderBy("cluster")).alias("global_id"))
    return joined(points.where("inst is not null and inst <> 0"), ids, [*keys, "block", "inst"])


def credits(fps: DataFrame, keys: list[str], arm_family: str, radius: float = 2.0, families: int = 2) -> DataFrame:
    """(keys, credited): false positives of a family that enough other families' false positives confirm,
    counted once in each ball of the radius. fps: keys, point, fam, x, y, eligible."""
    some = fps.where("eligible").drop("eligible")
    mine = some.where(F.col("fam") == arm_family)
    seen = spatial.witnesses(mine, some.where(F.col("fam") != arm_family), radius, keys, "point").where(F.col("families") >= families)
    kept = matching.suppress(joined(mine, seen.select(*keys, "point"), [*keys, "point"]), keys, radius)
    return kept.groupBy(*keys).agg(F.count("*").alias("credited"))


def sensitivity(fps: DataFrame, keys: list[str], arm_family: str, radii: tuple[float, ...] = (1.5, 2.0, 3.0), families: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(keys, radius, families, credited): credits() over a grid of its parameters, in one plan.

    Witnesses are counted once for each radius and number of families; settings without credits have no row.
    """
    some = fps.where("eligible").drop("eligible")
    grid = F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.lit(int(k)).alias("families")) for r in radii for k in families])
    mine = some.where(F.col("fam") == arm_family).withColumn("_g", F.explode(grid)).select(*some.columns, "_g.radius", F.col("_g.families").alias("least"))
    near = spatial.within(mine, some.where(F.col("fam") != arm_family), max(radii), keys, extra=F.col("r_fam") != F.col("fam"))
    near = near.where(F.col("d2") <= F.col("radius") * F.col("radius"))
    seen = near.groupBy(*keys, "radius", "least", "point", "x", "y").agg(F.count_distinct("r_fam").alias("n")).where(F.col("n") >= F.col("least"))
    kept = matching.suppress_by(seen, [*keys, "radius", "least"], "radius")
    return kept.groupBy(*keys, "radius", F.col("least").alias("families")).agg(F.count("*").alias("credited"))
