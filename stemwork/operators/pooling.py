"""Pooling of scored cells: counts are summed first, rates follow from the sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemwork.functions.scalars import BANDS, CLASSES, f1, finite, half_even, rate, rung_order, total

CELL = ["site", "plot", "rung"]


def with_tp_core(cells: DataFrame) -> DataFrame:
    """Adds tp_core, the true positives inside the core, from precision where the column is missing."""
    return cells if "tp_core" in cells.columns else cells.withColumn("tp_core", half_even(F.col("precision") * F.col("n_det")))


def _hits(rec: str, n: str):
    """Sum over cells of the matches that a class's recall and size give back."""
    return total(F.when(F.col(n) > 0, half_even(F.col(rec) * F.col(n)))).cast("long")


def pool(cells: DataFrame, by: list[str], classes: tuple[str, ...] = CLASSES, *more: Column) -> DataFrame:
    """One row a group with n_plots (distinct cells), summed counts, the rates of the sums, and `more` aggregates.

    Columns for classes, height bands and credited precision appear if cells have what they need. Rates
    over nothing are NULL. The credited precision divides by no less than the true positives.
    """
    return _rates(*_sums(cells, by, classes, more))


def pool_with_all(cells: DataFrame, by: list[str], scope: str = "scope", part: str = "site") -> DataFrame:
    """pool() by scope and `by`, where a scope is a part or, named ALL, all of them; part is one of CELL.

    A cell has one part, so distinct cells and sums of the parts add up, and the cells themselves are pooled once.
    """
    sums, groups, credited = _sums(cells, [part, *by], CLASSES, ())
    added = [c for c in sums.columns if c not in (part, *by)]
    both = sums.withColumn(scope, F.explode(F.array(F.col(part), F.lit("ALL"))))
    return _rates(both.groupBy(scope, *by).agg(*[F.sum(c).alias(c) for c in added]), groups, credited)


def _sums(cells: DataFrame, by: list[str], classes: tuple[str, ...], more: tuple[Column, ...]) -> tuple[DataFrame, list[tuple[str, str, str]], bool]:
    """(counts and sums of each group, the classes (name, rate, size) that cells have, whether they have credits)."""
    cells, have = with_tp_core(cells), set(cells.columns)
    groups = [(c, f"rec_{c}", f"n_{c}") for c in classes if f"n_{c}" in have]
    if all(f"n_h_{b}" in have for b in BANDS):
        groups += [(f"h_{b}", f"rec_h_{b}", f"n_h_{b}") for b in BANDS]
    credited = "fp_credited" in have
    key = F.concat_ws("::", *[F.coalesce(F.col(k).cast("string"), F.lit("NA")) for k in CELL])
    aggs = [F.countDistinct(key).alias("n_plots"), *[total(c).cast("long").alias(c) for c in ("n_ref", "n_det", "TP", "tp_core")]]
    aggs += [x for g, rec, n in groups for x in (_hits(rec, n).alias(f"_tp_{g}"), total(n).cast("long").alias(n))]
    aggs += [total("fp_credited").cast("long").alias("_credit"), F.count_if(finite("fp_credited")).alias("_credits")] if credited else []
    aggs += more
    return cells.groupBy(*by).agg(*aggs), groups, credited


def _rates(out: DataFrame, groups: list[tuple[str, str, str]], credited: bool) -> DataFrame:
    """Sums with the rates of them; columns that start with _ go."""
    out = out.withColumns({"recall": rate("TP", "n_ref"), "precision": F.when(F.col("n_det") > 0, rate("tp_core", "n_det"))}).withColumn("F1", f1("recall", "precision"))
    for g, rec, n in groups:
        out = out.withColumn(rec, rate(f"_tp_{g}", n))
    if {"_tp_intermediate", "_tp_suppressed"} <= set(out.columns):
        out = out.withColumn("n_understory", F.col("n_intermediate") + F.col("n_suppressed"))
        out = out.withColumn("rec_understory", rate(F.col("_tp_intermediate") + F.col("_tp_suppressed"), "n_understory"))
    if credited:
        out = out.withColumn("fp_credited", F.when(F.col("_credits") > 0, F.col("_credit")))
        out = out.withColumn("precision_cred", rate("tp_core", F.greatest(F.col("n_det") - F.col("fp_credited"), "tp_core")))
        out = out.withColumn("F1_cred", f1("recall", "precision_cred"))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def equal_set_guard(cells: DataFrame, arms: list[str], keys: list[str] = CELL, arm: str = "detector") -> tuple[DataFrame, DataFrame]:
    """(rows of the cells that every arm has scored, keys of the other cells).

    Rows of further detectors in those cells stay. NULL keys are keys. A cell's arms are gathered over its own
    rows, which are as many as it has arms and settings, so the cells are read and shuffled once.
    """
    wanted = F.when(F.col(arm).isin(*arms), F.col(arm))
    kept = cells.withColumn("_arms", F.size(F.collect_set(wanted).over(W.partitionBy(*keys)))).where(F.col("_arms") == len(set(arms))).drop("_arms")
    dropped = cells.groupBy(*keys).agg(F.count_distinct(wanted).alias("_arms")).where(F.col("_arms") < len(set(arms))).drop("_arms")
    return kept, dropped


def pool_arms(cells: DataFrame, arms: list[str]) -> DataFrame:
    """Guarded pool by detector and rung, with the mean first-return density (two decimals) and the rung's place."""
    kept, _ = equal_set_guard(cells, arms)
    density = [F.bround(F.avg("frdens"), 2).alias("mean_frdens")] if "frdens" in cells.columns else []
    return pool(kept.where(F.col("detector").isin(*arms)), ["detector", "rung"], CLASSES, *density).withColumn("rung_place", rung_order("rung"))


def deltas(pooled: DataFrame, baseline: str, values: tuple[str, ...] = ("recall", "precision", "F1")) -> DataFrame:
    """By rung, each other detector's values less the baseline's (d_<value>); rungs without a baseline go.

    The baseline's values come from a window over the rung's pooled rows, one a detector.
    """
    rung = W.partitionBy("rung")
    of = lambda v: F.max(F.when(F.col("detector") == baseline, F.col(v))).over(rung)
    rows = pooled.withColumns({"_has": F.max((F.col("detector") == baseline).cast("int")).over(rung), **{f"base_{v}": of(v) for v in values}})
    rows = rows.where((F.col("_has") == 1) & (F.col("detector") != baseline))
    return rows.select("detector", "rung", *values, *[f"base_{v}" for v in values], *[(F.col(v) - F.col(f"base_{v}")).alias(f"d_{v}") for v in values])


def weighted_rmse(cells: DataFrame, by: list[str], rmse: str = "height_rmse", weight: str = "TP") -> DataFrame:
    """sqrt of the mean of rmse squared, weighted, over cells that have one."""
    ok = F.when(finite(rmse) & (F.col(weight) > 0), F.lit(1))
    return cells.groupBy(*by).agg(F.sqrt(rate(F.sum(ok * F.col(weight) * F.col(rmse) * F.col(rmse)), F.sum(ok * F.col(weight)))).alias(rmse))


def storeys(cells: DataFrame, by: list[str]) -> DataFrame:
    """Recall of the upper (dominant, codominant) and lower (intermediate, suppressed) storey."""
    sums = cells.groupBy(*by).agg(*[_hits(f"rec_{c}", f"n_{c}").alias(f"_tp_{c}") for c in CLASSES], *[total(f"n_{c}").cast("long").alias(f"_n_{c}") for c in CLASSES])
    two = lambda p, a, b: F.col(f"{p}{a}") + F.col(f"{p}{b}")
    over, under = CLASSES[:2], CLASSES[2:]
    out = sums.withColumns({"n_over": two("_n_", *over), "n_under": two("_n_", *under), "tp_over": two("_tp_", *over), "tp_under": two("_tp_", *under)})
    return out.select(*by, "n_over", "n_under", rate("tp_over", "n_over").alias("rec_over"), rate("tp_under", "n_under").alias("rec_under"))


def scopes(pooled: DataFrame, by: list[str], classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Pooled rows in long form: (by, scope, n, recall), scope all and each class."""
    parts = [F.struct(F.lit("all").alias("scope"), F.col("n_ref").alias("n"), F.col("recall").alias("recall"))]
    parts += [F.struct(F.lit(c).alias("scope"), F.col(f"n_{c}").alias("n"), F.col(f"rec_{c}").alias("recall")) for c in classes]
    return pooled.select(*by, F.explode(F.array(*parts)).alias("_s")).select(*by, "_s.scope", "_s.n", "_s.recall")


def pool_pq(cells: DataFrame, by: list[str], classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Panoptic rates of summed accumulators; columns that cells lack count as 0."""
    s = lambda c: (total(c) if c in cells.columns else F.lit(0))
    whole = ["TP", "FP", "FN", "n_pred", "n_ref"]
    aggs = [F.count("*").alias("n_cells"), *[s(c).cast("long").alias(c) for c in whole], *[s(c).cast("double").alias(c) for c in ("sum_iou", "sum_maxiou")]]
    aggs += [s(f"{p}_{c}").cast("long" if p in ("n", "tp") else "double").alias(f"_{p}_{c}") for c in classes for p in ("n", "tp", "sumiou", "sumcov")]
    out = cells.groupBy(*by).agg(*aggs)
    out = out.withColumns({"SQ": rate("sum_iou", "TP"), "RQ": rate("TP", F.col("TP") + 0.5 * F.col("FP") + 0.5 * F.col("FN")), "precision": rate("TP", "n_pred"), "recall": rate("TP", "n_ref"), "coverage": rate("sum_maxiou", "n_ref")})
    out = out.withColumns({"PQ": F.coalesce(F.col("SQ") * F.col("RQ"), F.lit(0.0)), "F1": f1("recall", "precision")})
    groups = {c: [c] for c in classes} | ({"understory": ["intermediate", "suppressed"]} if {"intermediate", "suppressed"} <= set(classes) else {})
    for g, members in groups.items():
        t = lambda p: sum((F.col(f"_{p}_{c}") for c in members[1:]), F.col(f"_{p}_{members[0]}"))  # noqa: B023, E731
        out = out.withColumns({f"n_{g}": t("n"), f"rec_{g}": rate(t("tp"), t("n")), f"SQ_{g}": rate(t("sumiou"), t("tp")), f"cov_{g}": rate(t("sumcov"), t("n"))})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def pair_cells(cells: DataFrame, a: str, b: str, keys: list[str] = CELL) -> tuple[DataFrame, DataFrame]:
    """(rows of arms a and b in cells that both have, one row n_drop: cells that one of them lacks)."""
    two = cells.where(F.col("detector").isin(a, b))
    kept, dropped = equal_set_guard(two, [a, b], keys)
    return kept, dropped.agg(F.count("*").alias("n_drop"))


def equivalence(scoped: DataFrame, a: str, b: str, by: str = "rung") -> DataFrame:
    """(scope, recall, n_ref and TP of a and of b, delta_recall): two poolings in long form set side by side.

    scoped: by, scope, recall, n_ref, TP. Scopes that one of them lacks go.
    """
    side = lambda v, s: scoped.where(F.col(by) == v).select(F.col("scope").alias(f"scope_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("recall", "n_ref", "TP")])
    rows = side(a, "a").join(side(b, "b"), F.col("scope_a") == F.col("scope_b"))
    return rows.drop("scope_b").withColumnRenamed("scope_a", "scope").withColumn("delta_recall", F.col("recall_a") - F.col("recall_b"))


def _held(cells: DataFrame, chosen: DataFrame, by: list[str], fixed: str) -> DataFrame:
    """cells whose `fixed` parameter is that chosen for their group, with what else was chosen."""
    c = chosen.withColumnsRenamed({k: f"_h{i}" for i, k in enumerate(by)} | {fixed: "_fixed"})
    return cells.join(c, [*[F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(by)], F.col(fixed) == F.col("_fixed")]).drop("_fixed", *[f"_h{i}" for i in range(len(by))])


def heldout_optimum(cells: DataFrame, chosen: DataFrame, by: list[str], item: str = "plot", param: str = "chm_res", fixed: str = "vwf_a", target: float = 0.5) -> DataFrame:
    """(by, fixed, cal_<param>, ho_<param>, ho_F1, F1_at_target, is_target, n_pool, n_drop, n_res): whether the best `param` holds out of sample.

    cells: the held-out rows. chosen: by, fixed, param, as calibration chose them. With `fixed` held there, F1
    is pooled for each value of `param` over the items that have all of the group's values; the greatest wins,
    of equal ones the finest. Groups without such items have NULLs and 0.
    """
    same = lambda p: [F.col(k).eqNullSafe(F.col(f"{p}{i}")) for i, k in enumerate(by)]
    named = lambda p: [F.col(k).alias(f"{p}{i}") for i, k in enumerate(by)]
    held = with_tp_core(_held(cells, chosen.select(*by, fixed, F.col(param).alias("_cal")), by, fixed))
    sums = [total(c).cast("long").alias(c) for c in ("n_ref", "n_det", "TP", "tp_core")]
    # one row an item with its counts by param: the rows are read once, all that follows is of this size
    items = held.groupBy(*by, item, F.col(param).alias("_p")).agg(*sums).groupBy(*by, item).agg(F.collect_list(F.struct("_p", "n_ref", "n_det", "TP", "tp_core")).alias("_ps"))
    need = items.select(*named("_n"), F.explode("_ps._p").alias("_p")).groupBy(*[f"_n{i}" for i in range(len(by))]).agg(F.count_distinct("_p").alias("_need"))
    judged = items.join(need, same("_n")).withColumn("_whole", F.size("_ps") == F.col("_need"))
    counts = judged.groupBy(*named("_c")).agg(F.count_if("_whole").alias("n_pool"), F.count_if(~F.col("_whole")).alias("n_drop"))
    rows = judged.where("_whole").select(*by, F.explode("_ps").alias("_x")).groupBy(*by, "_x._p").agg(*[F.sum(f"_x.{c}").alias(c) for c in ("n_ref", "n_det", "TP", "tp_core")])
    f = rows.withColumn("F1", f1(rate("TP", "n_ref"), F.when(F.col("n_det") > 0, rate("tp_core", "n_det"))))
    best = F.max(F.when(F.col("F1").isNotNull(), F.struct("F1", (-F.col("_p")).alias("low"))))
    found = f.groupBy(*named("_f")).agg(best.alias("_b"), F.max(F.when(F.abs(F.col("_p") - target) < 1e-9, F.col("F1"))).alias("F1_at_target"), F.count("F1").alias("n_res"))
    out = chosen.select(*by, fixed, F.col(param).alias(f"cal_{param}")).join(counts, same("_c"), "left").join(found, same("_f"), "left").na.fill(0, ["n_pool", "n_drop", "n_res"])
    out = out.withColumns({f"ho_{param}": -F.col("_b.low"), "ho_F1": F.col("_b.F1")})
    out = out.withColumn("is_target", F.when(F.col(f"ho_{param}").isNotNull(), F.abs(F.col(f"ho_{param}") - target) < 1e-9))
    return out.drop("_b", *[f"{p}{i}" for p in ("_c", "_f") for i in range(len(by))])


def slope_spread(cells: DataFrame, chosen: DataFrame, by: list[str], item: str = "plot", param: str = "vwf_a", fixed: str = "chm_res") -> DataFrame:
    """(by, fixed, f1_min, f1_max, spread, n_pool): how far pooled F1 moves with `param` where `fixed` is as chosen."""
    held = _held(cells, chosen.select(*by, fixed), by, fixed)
    f = pool(held, [*by, param], ()).groupBy(*by).agg(F.min("F1").alias("f1_min"), F.max("F1").alias("f1_max"))
    n = held.groupBy(*by).agg(F.count_distinct(item).alias("n_pool"))
    out = chosen.select(*by, fixed)
    for k, df in enumerate((f, n)):
        names = {c: f"_o{k}_{i}" for i, c in enumerate(by)}
        out = out.join(df.withColumnsRenamed(names), [F.col(c).eqNullSafe(F.col(m)) for c, m in names.items()], "left").drop(*names.values())
    return out.na.fill(0, ["n_pool"]).withColumn("spread", F.col("f1_max") - F.col("f1_min"))
