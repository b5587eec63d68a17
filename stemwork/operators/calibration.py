"""Reliability of scores and monotone calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemwork.functions.scalars import finite

from .keys import joined


def bin_of(prob, bins: int = 10) -> Column:
    """Number from 1 of the bin, by comparison with i * (1 / bins); closed on the left, the last on both sides."""
    p = F.least(F.greatest(F.col(prob) if isinstance(prob, str) else prob, F.lit(0.0)), F.lit(1.0))
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    return sum(((p >= e).cast("int") for e in edges), F.lit(1)).cast("int")


def reliability(scored: DataFrame, keys: list[str], prob: str = "prob", label: str = "label", bins: int = 10) -> DataFrame:
    """(keys, bin, n, mean_prob, obs_acc) with all bins of each group, empty ones with n 0. Needs keys."""
    seen = scored.groupBy(*keys, bin_of(prob, bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("mean_prob"), F.avg(F.col(label).cast("double")).alias("obs_acc"))
    every = scored.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return every.join(seen, [*keys, "bin"], "left").na.fill(0, ["n"])


def calibration_error(scored: DataFrame, keys: list[str], prob: str = "prob", label: str = "label", bins: int = 10) -> DataFrame:
    """(keys, ece): mean gap of predicted and observed, weighted by the bins' sizes."""
    rows = reliability(scored, keys, prob, label, bins).where("n > 0")
    return rows.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("obs_acc") - F.col("mean_prob"))) / F.sum("n")).alias("ece"))


def knots(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and fitted values of an isotonic regression: pools of adjacent violators, the last fit of ties."""
    ok = np.isfinite(score) & np.isfinite(label)
    score, label = score[ok], label[ok]
    order = np.argsort(score, kind="stable")
    score, label = score[order], label[order]
    sums: list[float] = []
    sizes: list[int] = []
    for y in label:
        sums.append(float(y))
        sizes.append(1)
        while len(sums) > 1 and sums[-2] * sizes[-1] >= sums[-1] * sizes[-2]:
            s, n = sums.pop(), sizes.pop()
            sums[-1] += s
            sizes[-1] += n
    fitted = np.repeat(np.array(sums) / np.array(sizes or [1]), sizes) if sums else np.empty(0)
    last = np.append(score[1:] != score[:-1], True) if len(score) else np.empty(0, bool)
    return score[last], fitted[last]


def _pools(sums, sizes, lows, highs) -> tuple[list[float], list[float], list[float], list[float]]:
    """Pools of adjacent violators merged until their means ascend; lows and highs are the least and greatest scores that end in a pool, NaN if none does."""
    out: tuple[list[float], list[float], list[float], list[float]] = ([], [], [], [])
    s, n, lo, hi = out
    for pool in zip(sums, sizes, lows, highs, strict=True):
        for kept, value in zip(out, pool, strict=True):
            kept.append(float(value))
        while len(s) > 1 and s[-2] * n[-1] >= s[-1] * n[-2]:
            s[-2:], n[-2:] = [s[-2] + s[-1]], [n[-2] + n[-1]]
            lo[-2:], hi[-2:] = [np.fmin(lo[-2], lo[-1])], [np.fmax(hi[-2], hi[-1])]
    return out


def fitted_knots(train: DataFrame, keys: list[str], score: str = "raw", label: str = "label") -> DataFrame:
    """(keys, kx, ky): ascending scores and fitted values of each group's isotonic regression, at the ends of its pools.

    Ranges of (keys, score) pool their own rows, equal scores lying together, and each group then merges the pools: of labels 0 and 1,
    n rows have in the order of n ** (2/3) at most, since the means of pools ascend. So no task holds a group's rows.
    """
    rows = train.where(finite(score) & finite(label)).select(*keys, "row", F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *keys, "s").sortWithinPartitions(*keys, "s", "row").withColumn("part", F.spark_partition_id())

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        for _, group in pd.concat(held).groupby(keys, dropna=False, sort=False):
            x = group.s.to_numpy(float)
            ends = np.where(np.append(x[1:] != x[:-1], True), x, np.nan)
            found = _pools(group.y, np.ones(len(x)), ends, ends)
            out = pd.DataFrame(dict(zip(("total", "size", "low", "high"), found, strict=True))).assign(part=group.part.iloc[0], place=range(len(found[0])))
            for k in keys:
                out[k] = [group[k].iloc[0]] * len(out)
            yield out[[*keys, "part", "place", "total", "size", "low", "high"]]

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "place"])
        totals, sizes, lows, highs = (np.array(v) for v in _pools(group.total, group["size"], group.low, group.high))
        some = ~np.isnan(lows)
        x, y = np.stack([lows[some], highs[some]], axis=1).ravel(), np.repeat((totals / sizes)[some], 2)
        once = np.append(True, x[1:] != x[:-1]) if len(x) else np.empty(0, bool)
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "kx": [x[once].tolist()], "ky": [y[once].tolist()]})

    pools = ranged.mapInPandas(pooled, f"{kinds}, part int, place int, total double, size double, low double, high double")
    return pools.groupBy(*keys).applyInPandas(merged, f"{kinds}, kx array<double>, ky array<double>")


def isotonic(train: DataFrame, apply: DataFrame, keys: list[str], score: str = "raw", label: str = "label", out: str = "cal") -> DataFrame:
    """apply with the calibrated score by group: linear between knots, constant beyond, within 0 and 1.

    train's rows in the order of `row` decide ties. Groups that train lacks get NULL, as NULL scores do.
    A group's knots, two a pool at most, are what meets its rows to calibrate.
    """
    fitted = fitted_knots(train, keys, score, label)
    at = F.col(score).cast("double")
    # how many knots are not above the score, by bisection in at most 40 steps
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(F.get("kx", ((s["lo"] + s["hi"]) / 2).cast("int")) <= at, F.struct((((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size("kx") + F.lit(1.0))).cast("int") + 1))
    k = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size("kx").alias("hi")), step, lambda s: s["lo"])
    x0, x1, y0, y1 = F.get("kx", k - 1), F.get("kx", k), F.get("ky", k - 1), F.get("ky", k)
    value = F.when(k == 0, F.get("ky", F.lit(0))).when(k == F.size("kx"), y0).otherwise(y0 + (y1 - y0) * F.try_divide(at - x0, x1 - x0))
    value = F.when(at.isNotNull() & F.col("kx").isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
    names = {c: f"_i{i}" for i, c in enumerate(keys)}
    return apply.join(fitted.withColumnsRenamed(names), [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left").withColumn(out, value).drop("kx", "ky", *names.values())


def out_of_sample(scored: DataFrame, keys: list[str], folds: int = 5, seed: int = 42, score: str = "raw", label: str = "label") -> DataFrame:
    """scored with cal, each row's from a fit on the other folds; the base rate in groups of fewer rows than folds.

    Folds go by a hash of the seed and `row`, so reruns and partitions don't matter.
    """
    from stemwork.functions.scalars import unit

    rows = scored.withColumn("fold", F.floor(unit(F.lit(seed), "row") * folds).cast("int"))
    copies = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("held <> fold").drop("fold")
    fitted = isotonic(copies.withColumnRenamed("held", "fold"), rows, [*keys, "fold"], score, label)
    by = W.partitionBy(*keys)
    small = F.count("*").over(by) < folds
    return fitted.withColumn("cal", F.when(small, F.avg(F.col(label).cast("double")).over(by)).otherwise(F.col("cal"))).drop("fold")


def precision_at_recall(scored: DataFrame, keys: list[str], target: float, score: str = "prob", label: str = "label", buckets: int = 4096) -> DataFrame:
    """(keys, precision) where the ranking by descending score (ties by `row`) first reaches the recall; NULL without positives.

    Sums of buckets of scores say in which one that is, and its rows alone are ranked. Scores that are NULL rank last.
    """
    hit, number = (F.col(label) == 1).cast("long"), F.col(score).cast("double")
    known = F.when(~F.isnan(number), number)
    ends = scored.groupBy(*keys).agg(F.min(known).alias("_lo"), F.max(known).alias("_hi"), F.coalesce(F.sum(hit), F.lit(0)).alias("_p"))
    at = F.coalesce(F.floor(F.try_divide(F.col("_hi") - number, F.col("_hi") - F.col("_lo")) * buckets), F.lit(0))
    rows = joined(scored, ends, keys).withColumn("_b", F.when(number.isNull(), F.lit(buckets + 1)).when(F.isnan(number), F.lit(-1)).otherwise(at).cast("long"))
    order = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = rows.groupBy(*keys, "_b", "_p").agg(F.count("*").alias("_n"), F.coalesce(F.sum(hit), F.lit(0)).alias("_tp"))
    sums = sums.withColumns({"_all": F.sum("_n").over(order), "_hits": F.sum("_tp").over(order)})
    reached = (F.col("_p") > 0) & (F.try_divide(F.col("_hits").cast("double"), F.col("_p").cast("double")) >= target)
    first = sums.where(reached).groupBy(*keys).agg(F.min(F.struct("_b", (F.col("_all") - F.col("_n")).alias("n0"), (F.col("_hits") - F.col("_tp")).alias("tp0"))).alias("_f"))
    inside = joined(rows, first, keys).where(F.col("_b") == F.col("_f._b"))
    rank = W.partitionBy(*keys).orderBy(F.col(score).desc(), "row")
    run = rank.rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = inside.withColumns({"_k": F.row_number().over(rank) + F.col("_f.n0"), "_t": F.coalesce(F.sum(hit).over(run), F.lit(0)) + F.col("_f.tp0")})
    there = F.try_divide(F.col("_t").cast("double"), F.col("_p").cast("double")) >= target
    found = inside.where(there).groupBy(*keys).agg(F.min_by(F.col("_t") / F.col("_k"), F.col("_k")).alias("precision"))
    return joined(ends.select(*keys), found, keys, "left")


def unit_range(rows: DataFrame, by: list[str], value: str, out: str = "prob") -> DataFrame:
    """Min-max normalization by group; 0.5 where a group's values are all alike. The ends come from one aggregate that joins the rows."""
    ends = rows.groupBy(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(by)]).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    both = rows.join(ends, [F.col(k).eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(by)])
    low, high = F.col("_low"), F.col("_high")
    scaled = F.when(high == low, 0.5).otherwise((F.col(value) - low) / F.when(high != low, high - low))
    return both.withColumn(out, scaled).drop("_low", "_high", *[f"_e{i}" for i in range(len(by))])
