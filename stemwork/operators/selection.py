"""Choosing rows: dedups with explicit order, best configurations, policies, splits and paired sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemwork.functions.scalars import finite, gaussian, unit


#: Parts that a stratum's order is cut into.
BUCKETS = 4096


def keep(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def most_complete(rows: DataFrame, keys: list[str], values: list[str], row: str) -> DataFrame:
    """The row of each key with the fewest NULLs among values, the first of equal ones."""
    holes = reduce(lambda a, b: a + b, [F.col(v).isNull().cast("int") for v in values])
    return keep(rows, keys, holes, F.col(row))


def nearest_date(left: DataFrame, events: DataFrame, keys: list[str], when: str, target: str, tie: str) -> DataFrame:
    """left with its nearest event by absolute distance in time to the date; NULLs where there is none."""
    gap = F.abs(F.unix_micros(F.col(when).cast("timestamp")) - F.unix_micros(F.lit(target).cast("timestamp")))
    return left.join(keep(events, keys, gap, F.col(tie)), keys, "left")


def height_classes(rows: DataFrame, by: list[str], value: str, least: int = 4) -> DataFrame:
    """rows with class by their group's quantiles .33, .66 and .9 (right-closed), NULL in groups of fewer values.

    Quantiles come from one aggregate that joins the rows, so no window holds a group.
    """
    cuts = F.percentile(F.col(value), F.array(F.lit(0.33), F.lit(0.66), F.lit(0.9)))
    groups = rows.groupBy(*[F.col(k).alias(f"_q{i}") for i, k in enumerate(by)]).agg(cuts.alias("_cuts"), F.count(value).alias("_n"))
    v, q = F.col(value), lambda k: F.get("_cuts", F.lit(k))
    kind = F.when(v <= q(0), "suppressed").when(v <= q(1), "intermediate").when(v <= q(2), "codominant").when(v > q(2), "dominant")
    joined = rows.join(groups, [F.col(k).eqNullSafe(F.col(f"_q{i}")) for i, k in enumerate(by)])
    return joined.withColumn("height_class", F.when(F.col("_n") >= least, kind)).drop("_cuts", "_n", *[f"_q{i}" for i in range(len(by))])


def oracle(rows: DataFrame, value: str, keys: list[str], row: str) -> DataFrame:
    """(keys, arm) with the largest finite value of each cell, the first row of equal ones; cells without one go."""
    return keep(rows.where(finite(value)), keys, F.col(value).desc(), F.col(row)).select(*keys, "arm")


def policy_rows(rows: DataFrame, picks: DataFrame, keys: list[str], row: str) -> DataFrame:
    """The first row of each picked (keys, arm); picks without one vanish."""
    names = {c: f"_p{i}" for i, c in enumerate([*keys, "arm"])}
    first = keep(rows, [*keys, "arm"], F.col(row))
    chosen = picks.select(*[F.col(c).alias(n) for c, n in names.items()])
    return first.join(chosen, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left_semi")


def best(pooled: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The best configuration of each group in the order."""
    return keep(pooled, by, *order)


def folds(rows: DataFrame, plot: str = "plot") -> DataFrame:
    """rows with fold, the rank from 1 of their plot among the sorted distinct plots.

    Ranks are found on the distinct plots alone, which then join the rows.
    """
    ids = rows.select(F.col(plot).alias("_plot")).distinct().withColumn("fold", F.row_number().over(W.orderBy("_plot")))
    return rows.join(ids, F.col(plot).eqNullSafe(F.col("_plot"))).drop("_plot")


def complete_cases(rows: DataFrame, unit_: str, level: str, by: list[str]) -> DataFrame:
    """Rows of the units that have every level that their group has."""
    need = rows.groupBy(*by).agg(F.count_distinct(level).alias("_need")).withColumnsRenamed({k: f"_b{i}" for i, k in enumerate(by)})
    have = rows.groupBy(*by, unit_).agg(F.count_distinct(level).alias("_have"))
    whole = have.join(need, [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(by)]).where("_have = _need").select(*[F.col(k).alias(f"_w{i}") for i, k in enumerate([*by, unit_])])
    return rows.join(whole, [F.col(k).eqNullSafe(F.col(f"_w{i}")) for i, k in enumerate([*by, unit_])], "left_semi")


def population(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups of at least so many."""
    big = rows.groupBy(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)]).count().where(F.col("count") >= least)
    return rows.join(big, [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(keys)], "left_semi")


def mix_class(plots: DataFrame) -> DataFrame:
    """plots with crown_mix: understory if there are such stems and at least a quarter as many as above."""
    under = (F.col("n_under") > 0) & (F.col("n_under") >= F.col("n_over") / 4)
    return plots.withColumn("crown_mix", F.when(under, "understory").otherwise("overstory"))


def split(rows: DataFrame, strata: list[str], item: str, seed: int, share: float) -> DataFrame:
    """rows with split: ceil(share * n), at least one, of each stratum to calib and the others to valid, by hash of
    seed and item.

    Places in the order are found in BUCKETS equal parts of the hash, so no window holds a stratum.
    """
    u = rows.withColumn("_u", unit(F.lit(seed), item)).withColumn("_b", F.floor(F.col("_u") * BUCKETS).cast("int"))
    sizes = u.groupBy(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(strata)], F.col("_b").alias("_sb")).agg(F.count("*").alias("_m"))
    whole = W.partitionBy(*[f"_s{i}" for i in range(len(strata))])
    sizes = sizes.withColumns({"_before": F.sum("_m").over(whole.orderBy("_sb").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_m"), "_all": F.sum("_m").over(whole)})
    joined = u.join(sizes, [*[F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(strata)], F.col("_b") == F.col("_sb")])
    place = F.col("_before") + F.row_number().over(W.partitionBy(*strata, "_b").orderBy("_u", item))
    n = F.greatest(F.lit(1), F.ceil(share * F.col("_all")))
    return joined.withColumn("split", F.when(place <= n, "calib").otherwise("valid")).drop("_u", "_b", "_sb", "_m", "_before", "_all", *[f"_s{i}" for i in range(len(strata))])


def jitter(stems: DataFrame, seed: int | Column, sigma: str, item: str) -> DataFrame:
    """stems with x and y moved by normal errors of their sigma (0 if NULL, not finite or negative)."""
    s = F.when(finite(sigma) & (F.col(sigma) > 0), F.col(sigma)).otherwise(0.0)
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return stems.withColumns({"x": F.col("x") + gaussian(seed, item, F.lit("x")) * s, "y": F.col("y") + gaussian(seed, item, F.lit("y")) * s})


def draws(stems: DataFrame, k: int, seed: int, sigma: str, item: str) -> DataFrame:
    """stems k times over with their draw from 1 and positions jittered by it: one plan for all draws."""
    rows = stems.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return jitter(rows, F.lit(seed) + F.col("draw"), sigma, item)


def audit(rows: DataFrame, item: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by hash of seed and item: the same ones at every run."""
    return rows.orderBy(unit(F.lit(seed), item), item).limit(n)


def decimate(points: DataFrame, keys: list[str], per_area: float, side: float = 5.0, seed: int = 0, point: str = "point") -> DataFrame:
    """At most per_area * side^2 (half to even) points of each square, by hash of seed and point."""
    w = W.partitionBy(*keys, F.floor(F.col("x") / side), F.floor(F.col("y") / side)).orderBy(unit(F.lit(seed), point), point)
    return points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= round(per_area * side * side)).drop("_r")


def union_fill(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name, NULL where a frame lacks a column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_common(*frames: DataFrame) -> DataFrame:
    """Rows of all frames with the columns that all of them have."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    return reduce(lambda a, b: a.unionByName(b), [f.select(common) for f in frames])
